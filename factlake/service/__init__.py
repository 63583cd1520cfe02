"""Thin services over the text store: HTTP, command line, JSON-RPC."""
