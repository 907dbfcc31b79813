"""Operators for training data: source filtering, packing, mixing and redaction. Nothing else in the library imports this."""
