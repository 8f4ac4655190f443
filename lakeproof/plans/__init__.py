"""Bindings of the operators to the benchmark tables, each with its SQL twin."""
