"""Whole pipelines, from files or pages to reports."""
