"""From configuration to Spark plans."""
