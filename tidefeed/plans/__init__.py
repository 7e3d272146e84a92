"""Plan shapes the operators share: ordered work that no single key can hold up, and pruning."""
