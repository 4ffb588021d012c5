"""Whole pipelines built from the operators, and the engine facade."""
