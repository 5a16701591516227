"""Queries over the test tables, built from the operators, with their SQL twins."""
