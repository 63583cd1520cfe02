"""Relational operators over the fact log and what is derived from it."""
