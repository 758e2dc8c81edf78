"""Part of cellweave; see README.md."""
