"""Column functions: ids, residues, vectors."""
