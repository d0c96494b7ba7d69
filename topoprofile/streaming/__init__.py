"""Graph profiles are batch results; there is no streaming operator to offer."""
