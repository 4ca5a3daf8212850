"""Relational operators, sorting, records and indexes: functions from DataFrame to DataFrame."""
