"""Operators over swims: filters, rankings, best swims."""
