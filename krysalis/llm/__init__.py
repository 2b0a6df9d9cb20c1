"""Training-data operators: packing, deduplication, scoring, tokenising, cleaning.

Every operator is a function from DataFrames to a DataFrame; ``queries`` binds
them to the tables of a folder.
"""
