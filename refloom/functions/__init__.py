"""Column functions: text in, Column out. Nothing here reads or shuffles a table."""
