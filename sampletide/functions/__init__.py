"""Columns: rules with state, shredding of semi-structured samples, identifiers."""
