"""Stages from pages to scored answers; each maps tables to tables."""
