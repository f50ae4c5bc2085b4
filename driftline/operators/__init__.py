"""Operators on point streams: sessions, cleaning, matching, spatial joins, correctors."""
