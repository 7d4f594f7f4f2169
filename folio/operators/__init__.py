"""Folio operators."""
