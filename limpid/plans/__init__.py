"""Pipelines, recipes, profiles, samples and reports."""
