"""Causal graph analytics on Spark: fold, query, traverse and compare multi-writer graph history."""
