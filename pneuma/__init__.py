"""Spark jobs for respiration recordings: sessions, signals, breaths, agreement and streams."""
