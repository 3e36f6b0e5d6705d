"""Operators for training-data corpora: one module each, registered in ``queries``."""
