"""Helpers that shape plans: cutting lineage, checked broadcasts."""
