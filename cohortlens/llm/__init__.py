"""Operators of a training-data pipeline: decontamination, mixing, token files, duplicates, fixity, scoring, rules."""
