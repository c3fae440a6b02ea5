"""Siltstone: code-intelligence analytics expressed as Spark DataFrame plans."""
