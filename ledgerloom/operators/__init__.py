"""Relational and data-quality operators; each takes DataFrames and gives DataFrames."""
