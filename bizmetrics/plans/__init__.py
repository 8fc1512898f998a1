"""Whole jobs built from the operators: the report, the KPI row, the query catalogue."""
