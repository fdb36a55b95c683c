"""Readers and writers: tables, text feeds, file inventories, structure files, arrays."""
