"""Operators for preparing training data at scale: ten DataFrame-in, DataFrame-out functions.

Nothing else in the library imports this subpackage.
"""
