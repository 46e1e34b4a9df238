"""Column expressions: everything here stays inside one projection."""
