"""Rules and conjunctive queries, their rewriting, and their DataFrames."""
