"""Column-level building blocks (paths, slugs, globs, text, URLs)."""
