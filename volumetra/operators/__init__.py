"""Part of the volume engine."""
