"""DataFrame operators: joins, look-backs, roll-ups, features and evaluation."""
