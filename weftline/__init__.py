"""Patch-linkage and corpus analytics, written for Spark."""
