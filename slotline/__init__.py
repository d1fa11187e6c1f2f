"""Booking and scheduling analytics as plain Spark DataFrame functions."""
