"""Column functions and the numpy kernels that run inside Arrow batches."""
