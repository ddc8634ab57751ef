"""Whole queries: typeset, extract, repair, verify."""
