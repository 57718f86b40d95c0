"""Auditing of agent tool definitions and server configurations on Spark."""
