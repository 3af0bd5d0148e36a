"""Relational operators: joins by time and place, windows, estimators, graphs."""
