"""Column functions and small vectorised helpers."""
