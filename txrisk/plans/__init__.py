"""Whole workflows: prepare, train, evaluate, chart tables, predict, verify.

Each reads and writes named locations, so any of them can run in its own application.
"""
