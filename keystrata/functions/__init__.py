"""Part of keystrata."""
