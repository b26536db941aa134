"""Loads that go on as data arrives."""
