"""functions of the map library."""
