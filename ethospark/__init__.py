"""Behaviour analytics on Spark: poses, features, labels, bouts, evaluation."""
