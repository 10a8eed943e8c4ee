"""DataFrame operators: records, pages, change rows, schemas."""
