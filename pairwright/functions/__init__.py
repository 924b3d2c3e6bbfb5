"""pairwright functions."""
