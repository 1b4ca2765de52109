"""Telemetry analytics as composable PySpark DataFrame operators."""
