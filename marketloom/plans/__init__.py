"""Query plans and their compilation to Column expressions."""
