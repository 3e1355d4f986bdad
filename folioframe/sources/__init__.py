"""Readers and writers: listings, package documents, provider feeds, tables and exports."""
