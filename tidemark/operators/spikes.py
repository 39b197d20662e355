"""Implausible readings per source, by a local-level Kalman filter.

Each source's series is modelled on the log scale as a level that moves a
little plus noise. The filter runs forwards and backwards; a reading whose
standardised innovation exceeds the threshold in both directions is flagged and
its update withheld. A run of readings that agree with each other off the old
level is a change of level, which moves the filter instead. Where the variance
of the innovations of successive readings vanishes, the source is stuck.

Sources are cut into pieces by the rank of their readings, which prefix counts
over a range sort give, so neither gaps between positions nor a source of any
length change what is found.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: A source is cut into pieces of PIECE readings, each read with HALO readings
#: more at either side, over which the filter forgets where it began. No piece
#: grows with its source, however long that is.
PIECE, HALO = 256, 64


def _filter(y: np.ndarray, spread: np.ndarray, threshold: float, drift: float, settle: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of one pass, and the noise that its accepted innovations show. y:
    (series, time) logs, NaN where nothing was read; spread: noise assumed for
    each series; settle: readings in a row that agree with each other and make a
    new level."""
    g, n = y.shape
    r = spread**2
    q = drift * r
    out = np.zeros((g, n), bool)
    known = ~np.isnan(y)
    first = np.where(np.cumsum(known, axis=1) <= 7, y, np.nan)
    with np.errstate(all="ignore"):
        x = np.nanmedian(first, axis=1) if n else np.zeros(g)
    x = np.where(np.isnan(x), 0.0, x)
    p = r.copy()
    side_x, side_n = np.zeros(g), np.zeros(g, int)  # level and size of the present excursion
    side_at = np.full((g, settle), -1)
    rows = np.arange(g)
    total, used = np.zeros(g), np.zeros(g, int)
    for t in range(n):
        p = p + q
        ok = known[:, t]
        v = np.where(ok, y[:, t] - x, 0.0)
        s = p + r
        off = ok & (np.abs(v) > threshold * np.sqrt(s))
        use = ok & ~off
        total += np.where(use, v * v * r / s, 0.0)
        used += use
        gain = p / s
        x = np.where(use, x + gain * v, x)
        p = np.where(use, p * (1 - gain), p)
        side_n = np.where(use, 0, side_n)
        if off.any():
            out[off, t] = True
            agree = off & (side_n > 0) & (np.abs(y[:, t] - side_x) < 5 * spread * np.sqrt(1 + 1 / np.maximum(side_n, 1)))
            side_n = np.where(agree, side_n + 1, np.where(off, 1, side_n))
            side_x = np.where(agree, side_x + (y[:, t] - side_x) / np.maximum(side_n, 1), np.where(off, y[:, t], side_x))
            i = rows[off]
            side_at[i, side_n[i] - 1] = t
            moved = rows[off & (side_n >= settle)]
            if len(moved):
                out[moved[:, None], side_at[moved]] = False
                x[moved], p[moved], side_n[moved] = side_x[moved], r[moved] / settle, 0
    return out, np.where(used >= 8, np.sqrt(total / np.maximum(used, 1)), spread)


def vanishing(value: np.ndarray, usable: np.ndarray, stuck: int) -> np.ndarray:
    """Readings within stuck successive usable ones over which the variance of
    the innovations, each reading against the one before, is zero."""
    g, n = value.shape
    held = np.zeros((g, n), bool)
    if n < stuck:
        return held
    innovation = np.full((g, n), np.nan)
    innovation[:, 1:] = np.where(usable[:, 1:] & usable[:, :-1], value[:, 1:] - value[:, :-1], np.nan)
    over = np.lib.stride_tricks.sliding_window_view(innovation[:, 1:], stuck - 1, axis=1)  # windows of stuck readings
    with np.errstate(all="ignore"):
        still = (over * over).mean(axis=2) == 0
    for k in range(stuck):
        held[:, k : n - stuck + 1 + k] |= still
    return held


def _bursts(y: np.ndarray, spread: np.ndarray, threshold: float, near: int = 5, far: int = 20, least: int = 5) -> np.ndarray:
    """Readings of a burst long enough to pass for a level, after which the
    source is back where it was: off the medians of what lies near to far places
    before and after by more than the threshold, while these two agree. y: logs
    without what is flagged already. A burst may be half as long as such a
    stretch; at the ends of a series, with fewer than least readings in either,
    nothing is told."""
    g, n = y.shape
    if n < 2 * (near + least):
        return np.zeros((g, n), bool)
    pad = np.full((g, far), np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad], axis=1), far - near + 1, axis=1)
    before, after = w[:, :n], w[:, far + near : far + near + n]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a, b = np.nanmedian(before, axis=2), np.nanmedian(after, axis=2)
    known = ((~np.isnan(before)).sum(axis=2) >= least) & ((~np.isnan(after)).sum(axis=2) >= least)
    limit = threshold * spread[:, None] * np.sqrt(1 + 1 / least)
    with np.errstate(invalid="ignore"):
        return known & (np.abs(a - b) < limit) & (np.abs(y - a) > limit) & (np.abs(y - b) > limit)


def flag_series(value: np.ndarray, usable: np.ndarray, *, threshold: float = 5.0, drift: float = 0.03, settle: int = 5, stuck: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(off level, stuck) for (series, time) readings; usable marks those that
    are possible. Fewer than eight usable readings give no level, so nothing is
    off it."""
    g, n = value.shape
    held = vanishing(value, usable, stuck)
    y = np.full((g, n), np.nan)
    keep = usable & ~held
    y[keep] = np.log(value[keep])
    step = np.full((g, n), np.nan)  # against the last usable reading before
    last = np.full(g, np.nan)
    for t in range(n):
        step[:, t] = np.abs(y[:, t] - last)
        last = np.where(np.isnan(y[:, t]), last, y[:, t])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        spread = 1.4826 * np.nanmedian(step, axis=1) / np.sqrt(2 + drift)
        spread = np.maximum(np.where(np.isnan(spread), 1.0, spread), 1e-4)
        # the noise is estimated again from what the first pass accepted
        spread = np.maximum(_filter(y, spread, threshold, drift, settle)[1], 1e-4)
        ahead_off, behind_off = (_filter(y[:, ::way], spread, threshold, drift, settle)[0][:, ::way] for way in (1, -1))
    off = ahead_off & behind_off
    off |= _bursts(np.where(off, np.nan, y), spread, threshold)
    off &= (keep.sum(axis=1) >= 8)[:, None]
    return off, held


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted readings part, the number of the task's range, and nth,
    the place among the source's readings in this range."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
        new = np.r_[last is None or last != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        nth = np.arange(len(a)) - start
        carried = start < 0  # goes on with the source that the batch before ended with
        nth[carried] = seen + np.arange(int(carried.sum()))
        last, seen = (a[-1], b[-1]), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(a), part, np.int32)), pa.array(nth.astype(np.int64))], [*batch.schema.names, "part", "nth"])


def _offsets(ranges: list) -> dict[int, tuple[int, int, int]]:
    """part: (a, b, readings of that source before this part), for parts whose
    first source began before. ranges: per part in order its first and last
    source, the readings of the first, the last's, and whether they are one."""
    out, open_source, so_far = {}, None, 0
    for r in ranges:
        first, end = (r["fa"], r["fb"]), (r["la"], r["lb"])
        if first == open_source:
            out[r["part"]] = (*first, so_far)
        before = so_far if first == open_source else 0
        open_source, so_far = end, r["n_last"] + (before if first == end else 0)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Readings with their rank in the source, once for each piece that reads
    them."""
    for batch in batches:
        a, b, part, nth = (batch.column(c).to_numpy() for c in ("a", "b", "part", "nth"))
        rank = nth.copy()
        for p in np.unique(part).tolist():
            if p in before:
                fa, fb, n = before[p]
                rank[(part == p) & (a == fa) & (b == fb)] += n
        first, last = np.maximum(rank - HALO, 0) // PIECE, (rank + HALO) // PIECE
        row = np.repeat(np.arange(len(rank)), last - first + 1)
        piece = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("a", "b")], pa.array(piece), pa.array(rank[row]), *[batch.column(c).take(at) for c in ("id", "value", "possible")]], ["a", "b", "piece", "rank", "id", "value", "possible"])


def _flags(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, piece = batch.column("readings"), batch.column("piece").to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        parent = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        key, rank = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "rank"))
        val = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
        ok = flat.field("possible").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((rank, parent))
        parent, key, rank, val, ok = (x[order] for x in (parent, key, rank, val, ok))
        off, held = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if len(key):
            start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            length = np.diff(np.r_[start, len(parent)])
            by_length = np.argsort(length, kind="stable")
            for part in np.array_split(by_length, max(1, len(by_length) // 1024)):
                width = length[part].max()
                at = start[part][:, None] + np.arange(width)[None, :]
                inside = np.arange(width)[None, :] < length[part][:, None]
                where = np.where(inside, at, start[part][:, None])
                a, b = flag_series(np.where(inside, val[where], np.nan), inside & ok[where], **options)
                off[where[inside]], held[where[inside]] = a[inside], b[inside]
        hit = (rank // PIECE == piece[parent]) & (off | held)
        reason = np.where(held, "stuck", "off_level")
        yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(val[hit]), pa.array(reason[hit].tolist(), pa.string())], ["id", "value", "reason"])


def spikes(df: DataFrame, *, id_col: str, source: list[str], position: str, value: str, low: float = 0.0, high: float = 3_600_000.0, **options) -> DataFrame:
    """Readings that cannot be right beside the source's other readings.

    Returns (id, value, reason) with reason impossible (value <= low or > high),
    stuck (six or more in a row with the same value) or off_level. Repeated rows
    (same id) count once. A NULL or NaN value is never flagged and leaves a gap;
    it also ends a run of equal values. A NULL position can only be impossible.
    Readings at one position come in the order of their ids. NULL in a source
    column makes a source of its own (sources are told apart by 128 bits of
    hash). An empty table gives an empty result. Other columns, whatever their
    names, are not touched.

    Repeats go first, in each task before they are shuffled. Readings are then
    range-sorted by source and position and numbered within their source; what
    a source has in earlier ranges is one number per range. Pieces are cut by
    that number, so a source that holds a large part of all rows, or many rows
    at one position, is spread over many tasks.
    """
    v = F.col(value).cast("double")
    names = [F.col(c) for c in source]
    own = df.select(F.xxhash64(F.lit(1), *[x.isNull() for x in names], *names).alias("a"), F.xxhash64(F.lit(2), *[x.isNull() for x in names], *names).alias("b"), F.col(position).cast("long").alias("pos"), F.col(id_col).cast("long").alias("id"), v.alias("value"))
    own = own.distinct()
    impossible = (F.col("value") <= low) | ((F.col("value") > high) & ~F.isnan("value"))
    broken = own.where(impossible).select("id", "value", F.lit("impossible").alias("reason")).distinct()
    placed = own.where("pos IS NOT NULL").withColumn("possible", F.coalesce(~impossible & ~F.isnan("value"), F.lit(False)))
    schema = "a long, b long, pos long, id long, value double, possible boolean, part int, nth long"
    ranked = materialise(placed.repartitionByRange("a", "b", "pos", "id").sortWithinPartitions("a", "b", "pos", "id").mapInArrow(_ranked, schema))
    # one row per range: as many as tasks
    at = lambda f, c: f(F.struct("a", "b", "pos", "id"))[c]
    n_last = F.max_by("nth", F.struct("a", "b", "pos", "id", "nth")) + 1
    ends = ranked.groupBy("part").agg(at(F.min, "a").alias("fa"), at(F.min, "b").alias("fb"), at(F.max, "a").alias("la"), at(F.max, "b").alias("lb"), n_last.alias("n_last")).orderBy("part").collect()
    before = _offsets(ends)  # one entry per range at most

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, before)

    rows = ranked.mapInArrow(pieces, "a long, b long, piece long, rank long, id long, value double, possible boolean").select("a", "b", "piece", F.struct("rank", "id", "value", "possible").alias("r"))
    grouped = rows.groupBy("a", "b", "piece").agg(F.collect_list("r").alias("readings"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flags(batches, options)

    return grouped.select("readings", "piece").mapInArrow(flags, "id long, value double, reason string").unionByName(broken)
