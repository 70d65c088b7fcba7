"""Registered queries: each module has ``QUERIES`` (name to function of session and folder) and ``ORACLE`` (name to SQL)."""
