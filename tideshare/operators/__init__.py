"""Table operators: counts, shares, rankings and set partitions."""
