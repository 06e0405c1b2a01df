"""The queries that apply the library to the driver's tables."""
