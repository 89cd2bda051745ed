"""ledgerloom: payment-risk analytics on Spark DataFrames, in batch and as streams."""
