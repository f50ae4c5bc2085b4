"""Scalar, projection and geometry expressions."""
