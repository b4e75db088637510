"""plans of the map library."""
