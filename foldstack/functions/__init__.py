"""Column expressions: Column in, Column out, no actions and no Python on the data path."""
