"""Column functions: script profiles and predicates, text rewriting, names of files."""
