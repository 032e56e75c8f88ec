"""Column expressions with the missing-value and rounding rules of the study."""
