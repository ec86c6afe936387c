"""Parity-decoding analytics expressed as Spark DataFrame jobs."""
