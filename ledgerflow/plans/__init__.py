"""Whole plans: features, workflow, reports and the registered queries."""
