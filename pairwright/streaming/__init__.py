"""pairwright streaming."""
