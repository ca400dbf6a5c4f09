"""Operators for large text corpora.  Nothing else in symloom imports this subpackage."""
