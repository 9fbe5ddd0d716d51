"""Warehouse-table operators and query-log analytics as Spark DataFrame functions."""
