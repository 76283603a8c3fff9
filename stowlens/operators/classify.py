"""Classification rules; the order of tests is part of each rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowlens.functions.scalars import chain, ratio


def quota(used: Column, hard: Column, total: Column, warning: Column, critical: Column) -> Column:
    """By the hard quota, or by the total where there is none; with neither UNKNOWN."""
    base = F.when(hard > 0, hard).otherwise(total)
    pct = ratio(used * 100, base)
    return chain((base == 0, "UNKNOWN"), (used >= hard, "EXCEEDED"), (pct >= critical, "CRITICAL"), (pct >= warning, "WARNING"), otherwise="OK")


def replication(lag: Column, synced_ts: Column, updated_ts: Column, online: Column, now: Column, warning: int = 300, critical: int = 3600) -> Column:
    return chain(
        (~online, "FAILED"), (synced_ts == 0, "UNKNOWN"), (now - updated_ts > 3600, "STALLED"), (lag >= critical, "FAILED"), (lag >= warning, "LAGGING"), (lag < 0, "UNKNOWN"),
        otherwise="HEALTHY",
    )


def replication_of_group(failed: Column, stalled: Column, lagging: Column, healthy: Column, n: Column) -> Column:
    return chain((failed > 0, "FAILED"), (stalled > 0, "STALLED"), (lagging > 0, "LAGGING"), (healthy == n, "HEALTHY"), otherwise="UNKNOWN")


def pending(lag: Column, synced_bytes: Column) -> Column:
    return F.when((lag > 0) & (synced_bytes > 0), F.floor(lag / 10)).otherwise(0).cast("long")


def temperature(per_day: Column, hot: float = 10.0, cold: float = 0.1) -> Column:
    return chain((per_day >= hot, "hot"), (per_day <= cold, "cold"), otherwise="warm")


def alert_level(pct: Column, warning: float = 80.0, critical: float = 90.0) -> Column:
    return chain((pct >= critical, "critical"), (pct >= warning, "warning"), otherwise="ok")


def rebalance(pct: Column, high: float = 80.0, low: float = 60.0) -> Column:
    return chain((pct >= high, "overloaded"), (pct <= low, "underloaded"), otherwise="balanced")


def balance(imbalance_pct: Column) -> Column:
    return chain((imbalance_pct < 10, "balanced"), (imbalance_pct < 30, "slight imbalance"), otherwise="imbalanced")


def consistency(missing: Column, crc_differs: Column, size_differs: Column) -> Column:
    return chain((missing, "MISSING"), (crc_differs, "CRC_MISMATCH"), (size_differs, "SIZE_MISMATCH"), otherwise="OK")


def storage_health(active: Column, heartbeat_age: Column, free: Column, total: Column, uploads: Column, failed: Column, stale: int = 60) -> Column:
    """States OK, WARN and CRIT; the free share is whole per cents."""
    free_pct = F.when(total == 0, 100).otherwise(F.floor(free * 100 / total))
    return chain(
        (~active, "CRIT"), (heartbeat_age > stale, "CRIT"), (free_pct < 10, "CRIT"), (free_pct < 20, "WARN"), ((uploads > 100) & (ratio(failed, uploads) > 0.1), "WARN"), otherwise="OK",
    )


def space_check(used_pct: Column, strict: bool = False, warn: float = 85.0, fail: float = 95.0) -> Column:
    over = (lambda x: used_pct > x) if strict else (lambda x: used_pct >= x)
    return chain((over(fail), "FAIL"), (over(warn), "WARN"), otherwise="OK")


def network(consecutive: Column, loss_pct: Column, avg_ms: Column) -> Column:
    return chain((consecutive >= 3, "DOWN"), ((loss_pct >= 20) | (avg_ms >= 500), "CRITICAL"), ((loss_pct >= 5) | (avg_ms >= 100), "WARNING"), otherwise="OK")


def verification(present: Column, expected_crc: Column, crc: Column) -> Column:
    return chain((~present, "MISSING"), (expected_crc != crc, "CORRUPTED"), otherwise="OK")


def repair(present: Column, file_crc: Column, backup: Column, backup_crc: Column) -> Column:
    return chain((~present & ~backup, "FAILED"), (~present, "MISSING"), (backup & (file_crc != backup_crc), "CORRUPTED"), otherwise="OK")


def diagnostics(ok: Column, failed: Column, avg_ms: Column) -> Column:
    return chain((ok == 0, "ERROR"), ((failed > 0) | (avg_ms > 100), "WARNING"), otherwise="OK")


#: Labels of server states (fixed values).
STATUS_LABELS = {7: "ACTIVE", 5: "ONLINE", 6: "OFFLINE"}


def status_label(status: Column) -> Column:
    return chain(*[(status == k, v) for k, v in STATUS_LABELS.items()], otherwise="UNKNOWN")


def projected_days(free_to: Column, used: Column, per_day: Column) -> Column:
    """Days until `free_to` bytes are used at a growth, 0 if they are, -1 without growth."""
    return chain((used >= free_to, F.lit(0.0)), (per_day <= 0, F.lit(-1.0)), otherwise=(free_to - used) / per_day)


def priority(days_full: Column) -> Column:
    """1 within 30 days, 2 within 90 or without a date, else 3."""
    return chain(((days_full >= 0) & (days_full <= 30), 1), ((days_full >= 0) & (days_full <= 90), 2), (days_full < 0, 2), otherwise=3)


def worker_profile(cpus: Column, cap: int) -> Column:
    """Threads by CPUs, two at least and a cap at most."""
    return F.least(F.greatest(cpus * 2, F.lit(2)), F.lit(cap)).cast("int")
