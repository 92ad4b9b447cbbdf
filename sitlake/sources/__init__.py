"""Readers and adapters: tables to frames, checks, settings and control events."""
