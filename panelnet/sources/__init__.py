"""Readers of tables and archives."""
