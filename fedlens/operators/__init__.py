"""DataFrame operators: partitioning, poisoning, combining, metrics, run logs, reports, fitting."""
