"""Readers and writers: files and pages to tables, tables to files."""
