"""DataFrame operators: lines, logs, pairing, merging, budgets, code and evaluation."""
