"""Predictors: what turns peptides, alleles and profiles into scores."""
