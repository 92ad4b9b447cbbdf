"""Column functions: geometry, components of the score, and the fixed values they rest on."""
