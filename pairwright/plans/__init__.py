"""pairwright plans."""
