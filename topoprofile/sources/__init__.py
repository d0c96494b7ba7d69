"""Graph sources."""
