"""Compositions of operators: tree building from sequences, layouts and figures."""
