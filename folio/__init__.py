"""Folio: document question-answering analytics expressed on Spark DataFrames."""
