"""Stateful streams: completion of files that are still written, and hourly rate limits."""
