"""Events from a stream into a store's files."""
