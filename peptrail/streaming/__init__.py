"""Continuous screening of arriving sequences."""
