"""Rules over unbounded input."""
