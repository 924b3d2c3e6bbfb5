"""pairwright sources."""
