"""Readers of notices: federal CSV, release packages, listing pages, and small reference tables."""
