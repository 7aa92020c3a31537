"""Queries over the sample tables, by the name of the operator they show."""
