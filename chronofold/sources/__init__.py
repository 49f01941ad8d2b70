"""Event stores: reading, writing, schema."""

from chronofold.sources.store import EventStore

__all__ = ["EventStore"]
