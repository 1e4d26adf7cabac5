"""Configuration, parsed and resolved on the driver."""
