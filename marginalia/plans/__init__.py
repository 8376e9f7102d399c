"""Registered queries; importing this package registers them."""

from marginalia.plans import answers, asking, basics, cache, chunking, context, records, retrieval, sinks, store, texts, versions  # noqa: F401
