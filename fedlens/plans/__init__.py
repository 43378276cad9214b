"""Experiment plans: scenarios, strategies, report definitions and the federated loop."""
