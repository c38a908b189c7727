"""DataFrame operators, keyed by repository and query."""
