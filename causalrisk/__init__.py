"""causalrisk: event-level risk analytics as composable Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from causalrisk.session import build_session, discard, materialise, owner, prepare, release, scratch
from causalrisk.spec import CARD_PAYMENTS, EVENT_STREAM, DatasetSpec, EntityKey

__all__ = [
    "CARD_PAYMENTS",
    "DatasetSpec",
    "EVENT_STREAM",
    "EntityKey",
    "build_session",
    "discard",
    "materialise",
    "owner",
    "prepare",
    "release",
    "scratch",
]

# Functions that run in tasks travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
