"""Training-data operators: ten corpus operators, their queries and SQL."""
