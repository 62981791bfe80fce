"""The catalogue of queries and the SQL that says the same."""
