"""Operators on journals, catalogues, episodes, panels and alerts."""
