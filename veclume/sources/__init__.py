"""Files: binary vectors, weights, change logs."""
