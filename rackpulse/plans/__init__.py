"""Whole questions answered from tables: utilisation, temperature, polls and load inference."""
