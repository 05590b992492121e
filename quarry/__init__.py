"""An analytics engine on PySpark: DataFrame operators, Column functions, an SQL dialect, tables and streams."""
