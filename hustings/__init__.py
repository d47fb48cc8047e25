"""Roll-call and civic-record analytics as composable PySpark DataFrame operators."""
