"""The registry of named queries and their SQL."""
