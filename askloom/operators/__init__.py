"""Relational, text and retrieval operators over DataFrames."""
