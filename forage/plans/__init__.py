"""Compositions of operators that answer one request type end to end."""
