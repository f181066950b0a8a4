"""DataFrame -> DataFrame steps. Nothing here collects rows or triggers a job by itself,
except the two places that check the size of a dimension before inlining it."""
