"""Column expressions: row-wise measures, text clean-up and quality scores."""
