"""DataFrame operators: one DataFrame in, one DataFrame out."""
