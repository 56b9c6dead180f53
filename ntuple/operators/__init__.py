"""Encoders, tuple addressing, counting / Bloom / regression models and decision rules."""
