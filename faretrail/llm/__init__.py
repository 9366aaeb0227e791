"""Operators of a training-data pipeline.

A package of its own: nothing else in the library imports it, and its queries
(:mod:`faretrail.llm.queries`) are registered only when it is present.
"""
