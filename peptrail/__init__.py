"""Peptide screening on Spark: enumeration, curation, descriptors, pairwise comparison, ranking and evaluation."""
