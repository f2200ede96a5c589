"""Inventory and document-corpus analytics on Spark."""
