"""Training-data operators: archives, filters, duplicates, tokens, search."""
