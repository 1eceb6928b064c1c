"""Registered queries with their oracle SQL, and the inputs both are built from."""
