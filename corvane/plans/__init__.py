"""Importing this package registers every query."""

from corvane.plans import (  # noqa: F401
    cleaning,
    comparison,
    functions,
    graphs,
    ingest,
    joins,
    metrics,
    models,
    resampling,
    retrieval,
)
