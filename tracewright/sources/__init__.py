"""sources of the map library."""
