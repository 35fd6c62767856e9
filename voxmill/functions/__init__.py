"""Shapes, randomness, gather maps, matrices and numpy kernels."""
