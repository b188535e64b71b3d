"""Column expressions: text, checksums, detectors, masks, vectors."""
