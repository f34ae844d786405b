"""SQL front end, statistics and selectivity."""
