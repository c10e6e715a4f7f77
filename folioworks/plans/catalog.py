"""All registered queries."""

from __future__ import annotations

from folioworks.plans import (  # noqa: F401
    book_queries,
    document_queries,
    evaluation_queries,
    image_queries,
    markdown_queries,
    ocr_queries,
    record_queries,
    registry,
    search_queries,
    source_queries,
    stream_queries,
)


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)
