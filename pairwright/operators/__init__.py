"""pairwright operators."""
