"""Tape and ledger analytics on Spark DataFrames."""
