"""masklake streaming."""
