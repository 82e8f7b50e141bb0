"""Column functions: local time, missing values, intervals of proportions."""
