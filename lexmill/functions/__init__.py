"""Column functions: text normalisation, romanisation, classification."""
