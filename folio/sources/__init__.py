"""Folio sources."""
