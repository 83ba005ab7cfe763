"""Queries over the provided tables, with the SQL that states their results."""
