"""Registered queries, each beside SQL for the same rows."""
