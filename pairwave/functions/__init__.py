"""Column builders and small numeric kernels."""
