"""Data-processing operators over event tables."""
