"""Queries over the star schema, one an operator, with the SQL that checks each."""
