"""Recorded inputs: search payloads, feeds, sitemaps, robots files and pages. Nothing here opens a connection."""
