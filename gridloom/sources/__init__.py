"""Arrays from tables, array columns, ranges and local values, and back."""

from gridloom.sources.arrays import from_array_column, from_range, from_rows, from_table, from_values, to_table

__all__ = ["from_array_column", "from_range", "from_rows", "from_table", "from_values", "to_table"]
