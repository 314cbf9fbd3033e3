"""Column builders: residues and sequences, numeric rules."""
