"""Composed plans: derived inputs from the shared tables and the registered queries."""
