"""Extractors: source text to rows of declarations.  The only place where Python runs on executors."""
