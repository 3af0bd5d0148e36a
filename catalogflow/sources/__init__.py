"""Readers and writers of catalogs: CSV and Parquet tables, fixed-width records, XML, JSON."""
