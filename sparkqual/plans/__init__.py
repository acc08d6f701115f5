"""Plan shapes shared by the operators: long form, running totals, skew-safe joins."""
