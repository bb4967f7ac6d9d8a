"""Whole plans: assessments from files, and the registered queries over the driver's tables."""
