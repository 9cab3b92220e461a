"""The drafts' own schemas, as published (fixed values)."""
