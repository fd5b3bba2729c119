"""Column expressions: numbers, geometry and hexagon arithmetic."""
