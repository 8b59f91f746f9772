"""The registered queries over the given tables, each with its SQL where one exists."""

from __future__ import annotations

from causalrisk.catalog import explore, intake, models, risk, streams, text
from causalrisk.catalog.common import Query

MODULES = (intake, explore, risk, models, text, streams)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.CATALOG)
    return found
