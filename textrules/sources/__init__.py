"""Readers and writers: text files, CSV, web pages and timestamped record files."""
