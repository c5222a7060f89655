"""Applying a fitted cleaning plan to a Structured Streaming DataFrame.

The reference has no streaming; a fitted plan is stateless apart from
deduplication, so it applies unchanged to ``readStream`` input.
"""
