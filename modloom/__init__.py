"""modloom: graph clustering and partition analytics expressed as Spark plans."""
