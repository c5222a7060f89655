"""Strategies, the cleaning plan and the attempt loop."""
