"""Column-parameterised analytical operators over Spark DataFrames."""
