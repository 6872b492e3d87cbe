"""Operators for preparing training text at corpus scale. Nothing else in plotweave imports this package."""
