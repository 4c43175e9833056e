"""Session settings and plan helpers."""
