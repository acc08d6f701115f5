"""The same rules on arriving data."""
