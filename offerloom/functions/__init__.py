"""Column functions: all are built-in expressions that stay inside the engine."""
