"""Registered queries with their check SQL, grouped by family."""
