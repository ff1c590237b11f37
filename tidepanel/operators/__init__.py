"""Operators on tables: calendars, universes, preparation, processors, analytics."""
