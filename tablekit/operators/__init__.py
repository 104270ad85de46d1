"""Tables with a primary key, lookups, and pipelines."""
