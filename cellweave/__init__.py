"""cellweave: grid, scoring and selection analytics expressed as Spark plans."""
