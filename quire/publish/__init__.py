"""Packages: zip archives from file tables, and validation of any package as rows of issues."""
