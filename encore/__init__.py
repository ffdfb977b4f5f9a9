"""encore: play-log analytics as composable PySpark DataFrame functions."""
