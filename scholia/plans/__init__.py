"""Importing this package registers every query."""
