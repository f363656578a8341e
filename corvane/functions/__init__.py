"""Part of the corvane engine."""
