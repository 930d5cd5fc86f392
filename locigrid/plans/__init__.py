"""Queries over the given tables, each with an independent SQL form where one exists."""
