"""weftcode: transform-code analytics expressed as Spark plans."""
