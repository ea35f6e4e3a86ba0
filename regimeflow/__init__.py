"""Shock and regime analytics over large, time-ordered event tables, on Spark."""
