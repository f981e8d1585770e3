"""Column expressions: dates, places, kinship labels, text."""
