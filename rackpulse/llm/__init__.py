"""Operators for large training corpora, their queries and the SQL that checks them."""
