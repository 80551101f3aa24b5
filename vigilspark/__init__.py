"""Security analytics as Spark DataFrame operators."""

from .session import build_session, stage

__all__ = ["build_session", "stage"]
