"""Static inputs of the generator: task lists and model grids."""
