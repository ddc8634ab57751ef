"""Readers and writers: layouts, references, pages, workbooks, reports."""
