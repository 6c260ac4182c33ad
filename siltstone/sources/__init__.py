"""Readers and writers of structure, trajectory and scan formats."""
