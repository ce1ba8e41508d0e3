"""Configuration as tables, and the plans that follow from it."""
