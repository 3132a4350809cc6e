"""Column builders: frequencies, calendar features, scaling."""
