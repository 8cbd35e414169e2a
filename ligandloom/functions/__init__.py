"""Column -> Column expressions: values, labels, fingerprints, descriptors."""
