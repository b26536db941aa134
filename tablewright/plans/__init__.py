"""Whole jobs, and the queries of the contract."""
