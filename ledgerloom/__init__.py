"""Ledger analytics on Spark: one clean, traceable set of transactions, balances
and checks out of many overlapping statement files."""
