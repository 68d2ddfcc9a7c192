"""Column functions and Arrow functions for statistics that the engine lacks."""
