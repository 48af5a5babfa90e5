"""Column expressions: text, URLs, dates, extraction, identity and cards."""
