"""Schemas and column expressions shared by the operators and sources."""
