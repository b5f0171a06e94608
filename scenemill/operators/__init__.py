"""Operators of scene scoring and dataset curation."""
