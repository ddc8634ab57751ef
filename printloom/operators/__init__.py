"""DataFrame to DataFrame operators: geometry, comparison, conservation, repair, checks, bordered tables."""
