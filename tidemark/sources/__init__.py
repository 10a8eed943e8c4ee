"""Sources: directories of files, open tables, paged JSON responses."""
