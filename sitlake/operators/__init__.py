"""Operators on frames, checks and settings."""
