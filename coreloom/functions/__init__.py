"""Column expressions, label domains and test-statistic tails."""
