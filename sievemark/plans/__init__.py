"""Driver-side planning: dialects, the schema catalog and the choice of tier."""
