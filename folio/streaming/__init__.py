"""Folio streaming."""
