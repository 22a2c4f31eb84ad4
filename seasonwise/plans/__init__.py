"""Whole plans: views behind the dashboard, and queries on the driver tables."""
