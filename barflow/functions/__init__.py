"""Column builders: scalar rules and window features."""
