"""Continuous training, forgetting, clustering and scoring."""
