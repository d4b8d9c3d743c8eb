"""Operators over records: the index of JSON text, reconciliation, profiles, and the DataFrame lane."""
