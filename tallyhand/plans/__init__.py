"""Metric catalogues and the multi-step jobs built from the operators."""
