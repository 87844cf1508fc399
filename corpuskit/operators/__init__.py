"""DataFrame operators.  Every function takes and returns DataFrames; none collects its input."""
