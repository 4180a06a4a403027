"""Column expressions: text keys and SKU repair, numbers and money, dates, similarity."""
