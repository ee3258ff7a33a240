"""DataFrame to DataFrame operators. Each docstring gives the result for nulls, ties, repeats and empty input."""
