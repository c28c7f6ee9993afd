"""DataFrame operators: shaping, dedupe, joins, search and ledgers."""
