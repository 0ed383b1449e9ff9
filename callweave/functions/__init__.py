"""Column expressions: everything here is evaluated row by row inside Catalyst."""
