"""Column functions: vectors, filters, text, quantization."""
