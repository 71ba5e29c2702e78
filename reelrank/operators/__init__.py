"""DataFrame operators.  Each takes and returns DataFrames, takes thresholds
as parameters with the modelled app's defaults, and runs no action except
model fits."""
