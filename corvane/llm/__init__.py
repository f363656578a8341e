"""Operators for preparing training corpora: one module per operator, thin queries in ``queries``."""
