"""Scalar column functions: text normalisation, ordered classifiers, number and date parsing, similarity."""
