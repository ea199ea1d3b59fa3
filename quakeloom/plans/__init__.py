"""Whole workloads: the analyses as compositions of operators, and the registered queries."""
