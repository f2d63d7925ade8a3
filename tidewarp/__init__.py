"""tidewarp: time-series clustering and cluster-drift analytics on Spark.

Dense windowed series per entity and time point, min-max normalised,
clustered by k-means under dynamic time warping (or soft-DTW), with the
number of clusters chosen by a centroid silhouette. Cluster profiles,
migration, companion stability and a streaming assignment sit on top.
"""

from tidewarp.config import RunConfig

__all__ = ["RunConfig"]
