"""Strandline: supply-chain security analytics expressed as Spark jobs."""
