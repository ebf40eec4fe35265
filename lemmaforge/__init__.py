"""Contextual Hebrew lemmatization and search preparation on Spark DataFrames."""
