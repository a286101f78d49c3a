"""Operators for preparing text and task corpora for training. Nothing outside this subpackage imports it."""
