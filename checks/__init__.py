"""Stand-in inputs, the registered queries and their SQL oracles."""
