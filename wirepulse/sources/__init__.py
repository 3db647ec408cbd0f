"""Readers and writers: export text, zip archives, JSON lines, GeoJSON, landing table."""
