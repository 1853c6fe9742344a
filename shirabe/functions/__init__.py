"""Column expressions: no Python runs per row in this subpackage."""
