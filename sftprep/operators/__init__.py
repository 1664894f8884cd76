"""DataFrame -> DataFrame operators: ordering, splits, vocabularies, joins, metrics."""
