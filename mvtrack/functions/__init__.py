"""Column functions: geometry and scores as plain expressions."""
