"""Timberline: log ingestion, normalisation and analytics as Spark DataFrame operators."""

from timberline.schema import LEVELS, LOG_SCHEMA
from timberline.session import get_session, stage

__all__ = ["LEVELS", "LOG_SCHEMA", "get_session", "stage"]
