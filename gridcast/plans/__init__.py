"""Whole jobs made of operators: curation, forecasting, evaluation."""
