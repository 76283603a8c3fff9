"""Predicates with optional criteria, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowlens.functions import scalars as S

#: Operations of a change log by who made them: at the source in capitals, at a replica in small letters (fixed values).
SOURCE_OPS = ["C", "A", "D", "U", "M", "T", "L", "R"]
REPLICA_NEVER = ["a", "m", "t"]
#: Server states in their order (fixed values).
ACTIVE, OFFLINE = 7, 6


def combine(criteria: list[Column], any_of: bool = False) -> Column:
    """All criteria, or any of them; no criteria match nothing."""
    if not criteria:
        return F.lit(False)
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), criteria)


def file_criteria(
    *, size: Column | None = None, min_size: int = 0, max_size: int = 0, time: Column | None = None, after: int = 0, before: int = 0,
    name: Column | None = None, extension: str | None = None, pattern: str | None = None, has_metadata: Column | None = None,
) -> dict[str, Column]:
    """The stated criteria by name: bounds are inclusive and 0 leaves a side open."""
    found: dict[str, Column] = {}
    if size is not None and (min_size or max_size):
        found["size"] = combine([c for c, on in ((size >= min_size, min_size), (size <= max_size, max_size)) if on])
    if time is not None and (after or before):
        found["date"] = combine([c for c, on in ((time >= after, after), (time <= before, before)) if on])
    if name is not None and extension:
        found["extension"] = S.extension_of_name(name) == extension.lower()
    if name is not None and pattern:
        found["pattern"] = S.glob(S.base_name(name), pattern)
    if has_metadata is not None:
        found["metadata"] = has_metadata
    return found


def match_reason(criteria: dict[str, Column]) -> Column:
    """Names of the criteria that a row meets, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in criteria.items()])), ",")


def tags_match(tags: Column, wanted: list[str], every: bool) -> Column:
    asked = F.array(*map(F.lit, wanted))
    return F.size(F.array_except(asked, tags)) == 0 if every else F.arrays_overlap(tags, asked)


def status_is(status: Column, op: str, value: int) -> Column:
    return status == value if op == "=" else status != value if op == "!" else F.lit(False)


def reserved_mb(total: Column, reserved: int | float) -> Column:
    """An amount in MB, or a ratio of the total for a float."""
    return F.floor(total * reserved).cast("long") if isinstance(reserved, float) else F.lit(reserved).cast("long")


def has_space(free: Column, total: Column, reserved: int | float) -> Column:
    """More free than reserved; with a ratio, nothing is free of an empty total."""
    return (F.when(total == 0, False).otherwise(free / total > reserved)) if isinstance(reserved, float) else free > reserved


def tracker_filter(leader: Column, heartbeat_age: Column, only_leader: bool | None = None, only_active: bool | None = None) -> Column:
    """Rows by two optional flags; active is the leader or one heard of within three seconds."""
    active = leader | (heartbeat_age <= 3)
    asked = [c if want else ~c for c, want in ((leader, only_leader), (active, only_active)) if want is not None]
    return combine(asked) if asked else F.lit(True)


def available_mb(free: Column, reserved: Column, counted: Column) -> Column:
    return F.when(counted, F.greatest(free - reserved, F.lit(0))).otherwise(0)


def needs_sync(op: Column, ts: Column, until: Column, old_data: Column) -> Column:
    """Source operations; of a replica's, old data up to a time, but never its appends, changes and cuts."""
    return op.isin(SOURCE_OPS) | (~op.isin(SOURCE_OPS) & ~op.isin(REPLICA_NEVER) & old_data & (ts <= until))


def readable(is_source: Column, file_ts: Column, synced_ts: Column, now: Column, max_delay: int = 86400, max_time: int = 300) -> Column:
    """Whether a replica can be read: the source itself, long past any delay, or synced far enough."""
    return is_source | (file_ts < now - max_delay) | (synced_ts > file_ts) | ((synced_ts + 1 >= file_ts) & (now - file_ts > max_time))


def expired_status(status: Column, heartbeat: Column, now: Column, interval: int) -> Column:
    return F.when((status == ACTIVE) & (now - heartbeat > interval), OFFLINE).otherwise(status)
