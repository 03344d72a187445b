"""Column-level building blocks: text, time, numbers and vectors."""
