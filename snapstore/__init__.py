"""Snapshot analytics on Spark: content identities, trees, history and three-way comparison as DataFrame plans."""
