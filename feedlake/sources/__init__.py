"""Readers, loaders, table schemas and the driver-table mapping."""
