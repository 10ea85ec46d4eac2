from shelfcast.sources.tables import read_table, TABLE_NAMES

__all__ = ["read_table", "TABLE_NAMES"]
