"""Whole audits and the registered queries."""
