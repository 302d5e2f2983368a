"""DataFrame operators: sketches, windows, metric tables, ranking and control."""
