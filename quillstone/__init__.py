"""Double-entry ledger analytics expressed as Spark DataFrame plans."""
