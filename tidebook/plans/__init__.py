"""Queries over the benchmark tables and the SQL that checks them."""
