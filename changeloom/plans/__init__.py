"""Registered queries and the SQL that another engine can run on the same tables to check them."""
