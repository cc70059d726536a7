"""Spark-native market-research analytics engine."""
