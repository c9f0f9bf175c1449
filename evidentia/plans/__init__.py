"""Whole evaluations, model interfaces and the contract queries."""
