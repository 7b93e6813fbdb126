"""Readers and writers of dumps, journals, feeds, catalogs and published tables."""
