"""Stateful and ordered-event operators."""
