"""DataFrame-in, DataFrame-out operators, each for many plants at once."""
