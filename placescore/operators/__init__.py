"""DataFrame operators: joins, aggregates, ordering and iterative jobs."""
