"""Column expressions: arithmetic, log-likelihood terms, gamma weights, partition arrays."""
