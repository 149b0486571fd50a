"""Lexmere: a PySpark engine for versioned legal-text corpora and legislative records."""
