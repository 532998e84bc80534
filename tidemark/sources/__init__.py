"""Feeds, slices, bronze storage and the FX dimension."""
