"""Readers and writers of books, fact files, manifests and reports."""
