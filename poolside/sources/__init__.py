"""Readers that give the domain's tables."""
