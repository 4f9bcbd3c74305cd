"""Operators for training text: leaked test items, source mixtures, subject areas."""
