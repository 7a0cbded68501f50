"""Configuration, registries and whole deployments."""
