"""Relational and graph operators over reads, k-mers and components."""
