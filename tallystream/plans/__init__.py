"""User-level answers and the catalogue of runnable queries with their SQL counterparts."""
