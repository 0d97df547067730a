"""Feeding a store from a stream."""
