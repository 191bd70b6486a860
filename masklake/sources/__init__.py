"""masklake sources."""
