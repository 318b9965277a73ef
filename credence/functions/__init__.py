"""Column expressions: densities, the log-gamma function, counter-based uniforms, grids."""
