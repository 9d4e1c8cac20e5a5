"""Operators put together: from feeds to quotes, and from quotes to matches."""
