"""Readers of what stores publish: JSON and JSON-LD, meta tags, shop product documents, event streams, robots files, sitemaps, feeds."""
