"""masklake functions."""
