"""Column-to-column building blocks shared by the operators."""
