"""wayfold: Spark-native analytics over recorded drives, obstacles, risk frames and text tables."""
