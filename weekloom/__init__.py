"""Weekly demand-signal analytics, declared as Spark DataFrames."""
