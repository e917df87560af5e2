"""Stowage: file trees, archives and member stores as Spark tables."""
