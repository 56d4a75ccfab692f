"""Governance operators: quality, classification, lineage, fairness, drift, risk and rollups."""
