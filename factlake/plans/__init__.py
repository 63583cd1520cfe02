"""Planner, engine and text store: what decides before a DataFrame is built."""
