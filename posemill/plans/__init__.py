"""Registered queries over the star-schema tables, each beside the SQL that says the same."""
