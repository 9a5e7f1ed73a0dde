"""vicinal: vector vicinity search and data preparation on PySpark DataFrames."""
