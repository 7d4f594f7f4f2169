"""Folio plans."""
