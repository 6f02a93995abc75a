"""sigspark: multi-study signature scoring, keyed boosted-tree training,
model federation and ROC validation as Spark DataFrame jobs."""

__version__ = "0.1.0"
