"""Named queries and plan helpers (skew-safe numbering, plan checks)."""
