"""Extraction and evidence over streams of pages."""
