"""Live incident state."""
