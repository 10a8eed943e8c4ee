"""Destinations: directories of files and open tables."""
