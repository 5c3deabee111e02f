"""quillspark: auditable canonical records and relational analytics, built on Spark's own planner."""

__version__ = "0.1.0"
