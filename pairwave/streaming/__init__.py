"""Incremental pair counts over micro-batches."""
