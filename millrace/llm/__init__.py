"""Training-data operators: one module an operator, queries and SQL in ``registry``."""
