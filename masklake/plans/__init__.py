"""masklake plans."""
