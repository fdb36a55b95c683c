"""DataFrame operators: rules, joins, summaries, rankings, sets, checks, similarity, structures."""
