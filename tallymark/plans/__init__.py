"""Whole runs: the operators put together the way a user calls them."""
