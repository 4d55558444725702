"""Column functions: time, vectors and plane geometry."""
