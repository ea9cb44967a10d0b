"""Operators for text that language models are trained on; nothing outside imports this package."""
