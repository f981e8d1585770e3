"""Files, character sets, tables and artifacts."""
