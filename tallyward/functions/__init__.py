"""Column expressions and reshaping helpers shared by the operators."""
