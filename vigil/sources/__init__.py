"""Readers and writers of journals, catalogues and reports."""
