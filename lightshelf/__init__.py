"""A media-library analytics engine on Spark: search, facets, sessions, vectors, clustering and upkeep as DataFrame operators."""
