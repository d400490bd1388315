"""Sensitive-text analytics as DataFrame transformations.

Every detection is a row of a findings table; everything else (span merging,
replacement, restoration, vocabulary, corpus review, scoring) is relational work
over it.  ``gleaner.llm`` holds the training-data operators and is optional:
nothing outside that folder imports it.
"""
