"""lumenframe: image, point-set, curve, graph and descriptor analytics as Spark DataFrame queries."""
