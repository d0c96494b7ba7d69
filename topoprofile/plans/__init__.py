"""Multi-step plans: recursive profiles and roles."""
