"""Operators for training-data corpora; each module names its method."""
