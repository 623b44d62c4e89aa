"""cairn: archive analytics and relational operators for PySpark."""
