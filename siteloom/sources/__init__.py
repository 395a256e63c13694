"""Readers and writers of variant text, intervals, sequences, gene models and pedigrees."""
