"""Readers with explicit schemas, flatteners of nested inputs, and writers of table states."""
