"""Relational operators over item, issue, failure and state tables."""
