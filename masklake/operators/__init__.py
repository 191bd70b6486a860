"""masklake operators."""
