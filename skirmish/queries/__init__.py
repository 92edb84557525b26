"""Queries that bind the operators to the test tables, with oracle SQL."""
