"""streaming of the map library."""
