"""Readers and writers of tables, traces, templates and schema texts."""
