"""Reading of on-screen panels: numpy kernels behind one Arrow-batched operator."""
