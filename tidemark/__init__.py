"""Ledger analytics on PySpark."""
