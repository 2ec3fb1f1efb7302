"""Training-data operators: ten large-scale corpus operators and the queries that apply them."""
