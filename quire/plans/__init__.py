"""Whole plans: driver queries with their SQL, and the extract pipeline."""
