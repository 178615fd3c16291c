"""wharfline: a PySpark-native engine for freight-invoice audit and month-end accruals."""
