"""operators of the map library."""
