"""All queries of the library's own operators."""

from __future__ import annotations

from siltstone.plans import analyzers, files, findings, graphs, scalars, sources, streams
from siltstone.schema import Catalog

CATALOG = Catalog().merge(scalars.catalog, findings.catalog, analyzers.catalog, graphs.catalog, streams.catalog, sources.catalog, files.catalog)
