"""Tessera: code and document retrieval analytics expressed as PySpark plans."""
