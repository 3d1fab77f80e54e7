"""DataFrame-to-DataFrame operators: reshape, join, aggregate, panel, space, events, statistics."""
