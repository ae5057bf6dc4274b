"""Operators for preparing training data at scale: one module per operator.

``registered`` holds the queries; nothing else in the library imports this subpackage.
"""
