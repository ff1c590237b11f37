"""Reading and writing panels, universes and point-in-time records."""
