"""Evidence-ledger analytics on Spark DataFrames."""
