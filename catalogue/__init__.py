"""Registered queries with the SQL that gives the same result.

Each module has ``QUERIES`` (name to function) and ``SQL`` (name to text).
"""
