"""Incremental forms of the additive operators."""
