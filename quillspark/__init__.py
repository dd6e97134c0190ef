"""quillspark: a PySpark-native analytics engine for educational document collections."""

from quillspark.session import build_session

__all__ = ["build_session"]
