"""Part of tidemark; see the modules."""
