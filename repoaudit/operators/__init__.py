"""Per-repository computations: DataFrame in, DataFrame out."""
