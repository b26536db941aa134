"""Data onboarding on Spark: read, profile, clean, store, question, and read logs.

Every operator is a function from DataFrame to DataFrame (or to a small
summary). The caller owns the session; the library sets no master, memory or
partition count.
"""
