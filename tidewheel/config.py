"""Tag groups: which signals belong together, and how they are bucketed, filled and judged."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TagGroup:
    """A named set of tags with the width of its buckets (s), the longest gap to fill (buckets),
    the threshold of activity (in standard deviations), the length of its sequences, and the tags
    whose gaps between zeros are zero."""

    name: str
    tags: tuple[str, ...]
    bucket_s: int
    max_gap: int = 5
    activity: float = 0.3
    sequence: int = 24
    zero_fill: tuple[str, ...] = ()


def group_table(spark: SparkSession, groups: Iterable[TagGroup]) -> DataFrame:
    """tagname, tag_group, bucket_size_s: one row per tag of the configuration, a table of fixed size."""
    rows = [(tag, g.name, g.bucket_s) for g in groups for tag in g.tags]
    return spark.createDataFrame(rows, "tagname string, tag_group string, bucket_size_s int")


#: Bucket width, longest gap in the models and in the grouping study, activity
#: threshold and sequence length of each group of signals.
GROUP_CONSTANTS: dict[str, tuple[int, int, int, float, int]] = {
    "always_on": (5, 6, 17, 0.2, 24),
    "boom_active": (5, 6, 15, 0.3, 24),
    "hoist_active": (5, 6, 17, 0.3, 24),
    "hyd_common": (10, 4, 2, 0.3, 12),
    "slew_active": (5, 6, 26, 0.3, 24),
    "slew_power": (60, 2, 4, 0.3, 8),
    "thermal_drive": (30, 3, 9, 0.2, 8),
    "thermal_motor": (300, 2, 1, 0.2, 6),
    "thermal_resistor": (120, 2, 3, 0.2, 8),
}
#: Alarms that say nothing about a lift.
ALARM_BLACKLIST = (1335, 1336, 1285, 1275, 1288, 1276, 1286, 1287)
META_SEQUENCE = 12


def group_of(name: str, tags: Iterable[str], zero_fill: Iterable[str] = (), study: bool = False) -> TagGroup:
    """A group with the constants of its name; study takes the grouping study's gap limit."""
    bucket, model_gap, study_gap, activity, sequence = GROUP_CONSTANTS[name]
    return TagGroup(name, tuple(tags), bucket, study_gap if study else model_gap, activity, sequence, tuple(zero_fill))
