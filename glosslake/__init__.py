"""glosslake: citation and concept analytics on Spark DataFrames."""
