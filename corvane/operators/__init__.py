"""Relational, clustering and metric operators."""
