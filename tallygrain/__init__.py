"""tallygrain: claim checking and record keeping as Spark DataFrame jobs."""

from tallygrain.session import configure, get_session

__all__ = ["configure", "get_session"]
