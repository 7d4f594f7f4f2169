"""Folio functions."""
