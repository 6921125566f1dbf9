"""Relational operators: cleaning, aggregation, fusion, gating, quality, anomalies, bias, export."""
