"""Dictionaries, feeds, pages and stored quotes."""
