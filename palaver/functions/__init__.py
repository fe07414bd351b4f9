"""Part of palaver."""
