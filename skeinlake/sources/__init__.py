"""Readers and writers of the formats datasets come in: JSON lines and documents, CSV, TSV, XML, Parquet, archives, images."""
