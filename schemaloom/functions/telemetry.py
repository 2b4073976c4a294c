"""Column functions over table, index and plan statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.functions.numbers import round_up_half


def read_write_ratio(reads: Column, writes: Column) -> Column:
    reads, writes = F.greatest(reads, F.lit(0)), F.greatest(writes, F.lit(0))
    return F.when(writes == 0, F.when(reads > 0, 100.0).otherwise(1.0)).otherwise(round_up_half(reads / writes, 2))


def hot_efficiency(hot_updates: Column, updates: Column) -> Column:
    """Per cent of updates that stayed on their page; no updates count as 100."""
    return F.when(updates <= 0, 100.0).otherwise(round_up_half(hot_updates / updates * 100.0, 1))


def workload_class(ratio: Column) -> Column:
    return F.when(ratio >= 10, "READ_HEAVY").when(ratio >= 3, "BALANCED").when(ratio >= 1, "WRITE_LEANING").otherwise("WRITE_HEAVY")


def indexing_risk(ratio: Column, hot: Column, seq_scans: Column) -> tuple[Column, Column]:
    """(risk, advice) of one more index."""
    high, medium, wanted = ratio < 1, (hot >= 80) & (ratio < 5), (seq_scans >= 100) & (ratio >= 2)
    return (
        F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
        F.when(high, "AVOID_INDEXING_WRITE_HEAVY").when(medium, "PRESERVE_HOT_UPDATES").when(wanted, "CONSIDER_INDEXING").otherwise("MONITOR"),
    )


def cost_delta(baseline: Column, hypothetical: Column) -> Column:
    return F.when(baseline <= 0, 0.0).otherwise(round_up_half((baseline - hypothetical) / baseline * 100.0, 1))


def cost_advice(selected: Column, delta: Column) -> Column:
    return F.when(~selected, "REJECTED").when(delta >= 30, "STRONG").when(delta > 0, "MARGINAL").otherwise("REJECTED")


def tuple_header(nullable_columns: Column) -> Column:
    """Bytes of a row header with its null bitmap, padded to eight."""
    bitmap = F.ceil(nullable_columns / 8.0)
    return (F.ceil((23 + bitmap) / 8.0) * 8).cast("bigint")


def _bloat(pages: Column, optimal: Column) -> Column:
    ratio = F.when(pages > 0, (pages - optimal) / pages * 100.0).otherwise(0.0)
    return round_up_half(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(100.0)), 1)


def table_bloat(pages: Column, tuples: Column, width: Column, nullable: Column, fill: float = 100.0, page: int = 8192) -> tuple[Column, Column]:
    """(pages that would do, per cent of bloat)."""
    usable = F.lit(float(page - 24)) * (fill / 100.0)
    per_page = F.greatest(F.floor(usable / (tuple_header(nullable) + width + 4)), F.lit(1))
    optimal = F.ceil(tuples / per_page).cast("bigint")
    return optimal, _bloat(pages, optimal)


def index_bloat(pages: Column, tuples: Column, key_width: Column, fill: float = 90.0, page: int = 8192) -> tuple[Column, Column]:
    usable = F.lit(float(page - 40)) * (fill / 100.0)
    per_page = F.greatest(F.floor(usable / (key_width + 8)), F.lit(1))
    optimal = F.ceil(F.ceil(tuples / per_page).cast("double") * F.lit(1.1)).cast("bigint")
    return optimal, _bloat(pages, optimal)


def compaction_action(table: Column, index: Column, threshold: float = 25.0) -> Column:
    return (
        F.when((index >= 30) & (table < 10), "REINDEX")
        .when(table >= threshold, "REPACK")
        .when((table >= 10) & (table < 25), "TUNE")
        .otherwise("OPTIMAL")
    )


def index_space(reltuples: Column, live: Column, dead: Column, width: float = 32.0, work_mem: int = 64 << 20, factor: float = 1.75) -> tuple[Column, Column]:
    """(bytes of the finished index, bytes needed while it is built: spilled sort and log included)."""
    rows = F.greatest(reltuples, live + dead, F.lit(0))
    raw = rows * F.lit(float(width))
    size = F.when(rows > 0, F.ceil(raw / F.lit(0.9))).otherwise(F.lit(16384)).cast("bigint")
    spill = F.when(raw > work_mem, F.ceil(raw * F.lit(1.2))).otherwise(F.lit(0)).cast("bigint")
    return size, F.ceil(size * F.lit(min(2.0, max(1.5, factor))) + spill + F.ceil(size * F.lit(1.2))).cast("bigint")


def rewrite_space(heap: Column, toast: Column, indexes: Column) -> Column:
    return F.ceil((heap + toast) * 2.0 + indexes + (heap + toast) * 1.2).cast("bigint")


def headroom(available: Column, required: Column, factor: float = 1.25) -> Column:
    left = F.when(available > 0, (available - required) / available * 100.0).otherwise(0.0)
    return F.when(available < F.ceil(required * F.lit(float(factor))), "CRITICAL").when(left < 15, "WARNING").otherwise("SAFE")


def same_mount(data: Column, log: Column) -> Column:
    """Whether the log's folder lies on the data folder's mount, by path segments."""
    trim = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/+$", "")
    return (trim(log) == trim(data)) | F.startswith(trim(log), F.concat(trim(data), F.lit("/")))


def checkpoint_health(timed: Column, forced: Column) -> tuple[Column, Column]:
    total = timed + forced
    share = F.when(total == 0, 0.0).otherwise(forced / total * 100.0)
    return share, F.when(share > 50, "CRITICAL").when(share > 25, "HIGH").when(share > 10, "MODERATE").otherwise("LOW")


def archiver_state(archived: Column, failed: Column, last_archived: Column, last_failed: Column, now: Column, stale_s: int = 900, failing_s: int = 3600) -> Column:
    """Five states, decided in order: the latest failure, recovery from one, then the age of the last archive."""
    age = lambda t: F.unix_timestamp(now) - F.unix_timestamp(t)
    failures = (failed > 0) & last_failed.isNotNull()
    failed_last = last_archived.isNull() | (last_failed >= last_archived)
    by_age = F.when(age(last_archived) > stale_s, "STALE_ARCHIVE")
    return (
        F.when((archived == 0) & last_archived.isNull(), F.when((failed > 0) | last_failed.isNotNull(), "FAILING_NOW").otherwise("NEVER_ARCHIVED"))
        .when(failures & failed_last & ((age(last_failed) <= failing_s) | last_archived.isNull()), "FAILING_NOW")
        .when(failures & ~failed_last, F.coalesce(by_age, F.lit("RECOVERED")))
        .when(last_archived.isNotNull(), F.coalesce(by_age, F.lit("HEALTHY")))
        .otherwise(F.when(archived > 0, "HEALTHY").otherwise("NEVER_ARCHIVED"))
    )


def slot_danger(wal_status: Column, active: Column, retained: Column, most: int = 1 << 30) -> Column:
    """Why a replication slot is dangerous, or null."""
    status = F.lower(F.coalesce(wal_status, F.lit("")))
    return (
        F.when(status.isin("lost", "unreserved", "extended"), status)
        .when(~active & (retained > most), F.lit("inactive"))
    )


def retryable(state: Column, message: Column) -> Column:
    """Lock errors worth another attempt."""
    words = ("lock timeout", "canceling statement due to lock", "statement timeout", "deadlock detected", "could not obtain lock")
    said = F.lit(False)
    for w in words:
        said = said | F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit(w))
    return F.coalesce(state.isin("55P03", "57014"), F.lit(False)) | said
