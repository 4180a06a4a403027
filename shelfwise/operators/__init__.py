"""DataFrame operators: resolution, cleaning, keys, star, metrics, comparisons, trends, quality."""
