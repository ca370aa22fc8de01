"""Relational operators: spatial joins, graph components, rule evaluation."""
