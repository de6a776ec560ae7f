"""doclake: a PySpark-native engine for building and analysing a document library."""
