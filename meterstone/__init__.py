"""A metrics engine on Spark: keyed measurements, stateful aggregates, roll-ups, publishing; and tools for training text."""
