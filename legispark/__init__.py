"""legispark: a PySpark-native engine for versioned legal and regulatory text corpora."""
