from .tables import binary_table, check_columns, read_binary_csv, split_columns

__all__ = ["binary_table", "check_columns", "read_binary_csv", "split_columns"]
