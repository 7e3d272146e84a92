"""Tables in: stored feeds, operation logs, and the tables derived from ``events``."""
