"""Operators over whole tables: cleaning, profiling, storing, questions, text."""
