"""baitlens: Spark-native analytics for labelled URL, e-mail and short-message tables."""

__version__ = "0.1.0"
