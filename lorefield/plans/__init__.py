"""The registered queries: one module for each family of operators."""

from . import chats, governance, loading, retrieval, streams, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chats", "governance", "loading", "retrieval", "streams", "texts"]
