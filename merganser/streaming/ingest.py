"""Entities and participations as they arrive: the same expressions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.operators.match import with_names


def parsed_stream(entities: DataFrame) -> DataFrame:
    """Names of arriving entities, parsed; no state."""
    return with_names(entities)


def participation_stream(participation: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of each entity, counted as they arrive: event_id, entity_id, ts. A row that arrives twice within ``late`` counts once."""
    once = participation.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "entity_id"])
    return once.groupBy("entity_id").agg(F.count("*").alias("events"))
