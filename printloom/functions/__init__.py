"""Column functions: normalisers, joins of pieces, predicates, widths."""
