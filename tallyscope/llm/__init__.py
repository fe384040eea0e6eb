"""Training-data operators: quality, dedup, decontamination, scans, scoring, mixing.

Nothing else in the library imports this subpackage; ``queries`` registers the
``opN_<name>`` queries and their oracle SQL.
"""
