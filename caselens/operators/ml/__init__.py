"""Features, clusters, outliers and sampling of deviations."""
