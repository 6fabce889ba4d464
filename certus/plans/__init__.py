"""Plan helpers: staging tables, configuration objects and whole workloads."""
