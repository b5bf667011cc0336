"""Incremental folds and subscriptions."""
