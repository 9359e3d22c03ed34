"""Counting k-mers of reads that keep arriving."""
