"""Readers of inventories, hardware texts, samples, dumps, measures and dimensions."""
