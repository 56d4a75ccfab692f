"""Readers and writers: lake files, JDBC tables, script corpora, lineage events, result tables."""
