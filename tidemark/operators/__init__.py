"""Relational operators: normalise, dedupe, merge, snapshot, quality."""
