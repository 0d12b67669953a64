"""More of the query catalogue, by area; ``paperloom.queries`` registers all of it."""
