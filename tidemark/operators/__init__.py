"""Relational operators: scans, reconciliation, change records and drill-down."""
