"""Nearest-in-time measurements and interval joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.operators.cells import CUTS, counted_cells, covered_cells, dense_cells, with_cell
from wardframe.operators.ordered import SLICE, null_safe_join
from wardframe.session import pin

EARLIER = (Window.unboundedPreceding, -1)
CELL_MICROS = 24 * 3600 * 1_000_000
#: Rows of a partition that is sorted by time, about.
RUN_ROWS = 1_000_000
#: Sorted rows that are searched together, at least.
BLOCK_ROWS = 65_536


def _neighbours(
    anchors: DataFrame, events: DataFrame, keys: Sequence[str], at: Column, items: Sequence
) -> DataFrame:
    """One row per distinct anchor with an array ``near``: for each of the
    ``items`` the last event up to ``at`` and the first one after it, as structs
    ``before`` and ``after`` of (t, v).

    Anchors and events are dealt out by key and sorted by time once, an anchor
    being one row whatever the number of items; no anchor-event pair is built.
    A key with very many rows is divided at cuts of time, and there one summary
    row per part carries neighbours across.
    """
    keys, anchors = list(keys), anchors.distinct()
    rest = [c for c in anchors.columns if c not in keys]
    kind = events.schema["item"].dataType
    numbered = [x for i, v in enumerate(items) for x in (F.lit(v).cast(kind), F.lit(i).cast("short"))]
    place = F.try_element_at(F.create_map(*numbered), F.col("item"))
    marks = anchors.select(*keys, at.alias("t"), F.struct(F.lit(True).alias("_anchor"), *rest).alias("anchor"))
    listed = events.select(*keys, F.col("time").alias("t"), place.alias("place"), "value")
    run = listed.unionByName(marks, allowMissingColumns=True)
    group = keys
    # counted over all items, which is no less than any one item has
    times = events.select(*keys, F.col("time").alias("t")).unionByName(marks.select(*keys, "t"))
    dense, total = counted_cells(times, keys, "t", None)
    carried = None
    if dense is not None:
        group = [SLICE, *keys]
        run = _one_per_time(with_cell(run, keys, "t", None, dense, SLICE), [*group, "place", "t"])
        carried = _carried(run.where(F.col(CUTS).isNotNull()), keys, group, len(items))
        run = run.drop(CUTS)
    parts = max(run.sparkSession.sparkContext.defaultParallelism, -(-total // RUN_ROWS))
    kind = F.when(F.col("anchor").isNull(), 0).otherwise(1)
    # at equal times events precede anchors, and the largest value comes last
    order = [F.col("t").asc_nulls_first(), kind.asc(), F.col("value").asc_nulls_first()]
    ordered = run.repartition(parts, *group).sortWithinPartitions(*group, *order)
    types = {f.name: f.dataType.simpleString() for f in run.schema}
    event = f"struct<t:{types['t']},v:{types['value']}>"
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in group], f"anchor {types['anchor']}", f"near array<struct<before:{event},after:{event}>>"])
    near = ordered.mapInArrow(_search(group, len(items)), schema)
    if carried is not None:
        near = null_safe_join(near, carried, group, "left").withColumn("near", F.expr(
            "CASE WHEN carried IS NULL THEN near ELSE zip_with(near, carried, (n, c) -> named_struct("
            "'before', coalesce(n.before, c.before), 'after', coalesce(n.after, c.after))) END"))
    return near.select(*[F.col(c) if c in keys else F.col("anchor")[c].alias(c) for c in anchors.columns], "near")


def _search(group: Sequence[str], n_items: int):
    """Searches partitions that are sorted by ``group``, time, kind and value."""

    def first_of_group(rows: pa.Table) -> np.ndarray:
        """Rows that begin a group."""
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in group:
            values = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    def found(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        t, v = (rows.column(c).combine_chunks() for c in ("t", "value"))
        of, numbers = np.cumsum(new), np.arange(rows.num_rows)
        is_event = rows.column("anchor").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        # events of other items have no place
        place = rows.column("place").fill_null(-1).to_numpy()
        clock = t.cast(pa.int64()).fill_null(-(2**63)).to_numpy()
        anchors = numbers[~is_event]
        at = np.full((2, len(anchors), n_items), -1)
        for i in range(n_items):
            own = numbers[place == i]
            if not len(own):
                continue
            # of equal times the last event has the largest value
            ends = np.append((of[own[1:]] != of[own[:-1]]) | (clock[own[1:]] != clock[own[:-1]]), True)
            last = own[np.flatnonzero(ends)[np.cumsum(ends) - ends]]
            k = np.searchsorted(own, anchors)
            before, after = own[np.maximum(k - 1, 0)], last[np.minimum(k, len(own) - 1)]
            at[0, :, i] = np.where((k > 0) & (of[before] == of[anchors]), before, -1)
            at[1, :, i] = np.where((k < len(own)) & (of[after] == of[anchors]), after, -1)

        def events(places: np.ndarray) -> pa.StructArray:
            none = pa.array(places < 0)
            taken = pa.array(places, mask=places < 0)
            return pa.StructArray.from_arrays([t.take(taken), v.take(taken)], ["t", "v"], mask=none)

        pairs = pa.StructArray.from_arrays([events(side.ravel()) for side in at], ["before", "after"])
        near = pa.ListArray.from_arrays(np.arange(len(anchors) + 1, dtype=np.int32) * n_items, pairs)
        kept = rows.select([*group, "anchor"]).take(pa.array(anchors)).combine_chunks()
        columns = [kept.column(c).chunk(0) if kept.num_rows else rows.schema.field(c).type for c in (*group, "anchor")]
        return pa.RecordBatch.from_arrays([*columns, near], names=[*group, "anchor", "near"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        wanted = BLOCK_ROWS

        def ready(whole: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            new = first_of_group(rows)
            end = rows.num_rows if whole else int(np.flatnonzero(new)[-1])
            held[:] = rows.slice(end).to_batches()
            if rows.column("anchor").slice(0, end).null_count < end:
                yield found(rows.slice(0, end), new[:end])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= wanted:
                yield from ready(False)
                # a group that goes on is looked at again when it has doubled
                wanted = max(BLOCK_ROWS, 2 * sum(b.num_rows for b in held))
        if held:
            yield from ready(True)

    return searched


def _one_per_time(run: DataFrame, group: Sequence[str]) -> DataFrame:
    """``run`` with one event per key, item and time in dense cells.  Of equal
    times the largest value counts, so the others need not be sorted; the
    aggregate combines on the map side, however many rows share a time."""
    many = F.col("anchor").isNull() & F.col(CUTS).isNotNull()
    merged = run.where(many).groupBy(*group, CUTS).agg(F.max("value").alias("value"))
    return run.where(~many).unionByName(merged, allowMissingColumns=True)


def _carried(run: DataFrame, keys: Sequence[str], group: Sequence[str], n_items: int) -> DataFrame:
    """(``group``, ``carried``): per part of a divided key and item, the last
    event of the parts before it and the first event of the parts after it (one
    summary row per part)."""
    event, mine = "named_struct('t', t, 'v', value)", "FILTER (WHERE place = {0})"
    ends = run.groupBy(*group).agg(
        # of equal times the largest value, as in the search
        *[F.expr(f"max_by({event}, struct(t, value)) {mine.format(i)} AS final{i}") for i in range(n_items)],
        *[F.expr(f"min_by({event}, struct(t, value IS NULL, -value)) FILTER (WHERE place = {i} AND t IS NOT NULL) AS first{i}") for i in range(n_items)],
    )
    onward = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*EARLIER)
    back = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(*EARLIER)
    both = [
        F.struct(F.last(f"final{i}", ignorenulls=True).over(onward).alias("before"),
                 F.last(f"first{i}", ignorenulls=True).over(back).alias("after"))
        for i in range(n_items)
    ]
    return ends.select(*group, F.array(*both).alias("carried"))


def _winners(near: DataFrame, rank_at: Column, window: tuple[Column, Column] | None) -> DataFrame:
    """``near`` with the flags ``wins_before`` and ``wins_after``: the neighbour
    lies in the window and no event of the item is closer to ``rank_at``."""
    low, high = window or (F.lit(None), F.lit(None))
    inside = "" if window is None else " AND n.{0}.t >= _low AND n.{0}.t <= _high"
    # an event without time ranks behind every event that has one
    gap = "coalesce(abs(timestampdiff(MICROSECOND, n.{0}.t, _rank)), 4611686018427387904)"
    usable = "coalesce(n.{0} IS NOT NULL" + inside + ", false)"
    fields = [f"'has_{s}', {usable.format(s)}, 'gap_{s}', {gap.format(s)}" for s in ("before", "after")]
    same = "'before', n.before, 'after', n.after"
    wins = (
        "'wins_before', n.has_before AND (NOT n.has_after OR n.gap_before <= n.gap_after), "
        "'wins_after', n.has_after AND (NOT n.has_before OR n.gap_after <= n.gap_before)"
    )
    return (
        near.withColumns({"_rank": rank_at, "_low": low, "_high": high})
        .withColumn("near", F.expr(f"transform(near, n -> named_struct({same}, {', '.join(fields)}))"))
        .withColumn("near", F.expr(f"transform(near, n -> named_struct({same}, {wins}))"))
    )


def nearest_values(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    items: Mapping[str, object],
    window: tuple[Column, Column] | None = None,
    presence: bool = False,
    skip_null: bool = False,
) -> DataFrame:
    """The value of each item nearest in time to ``at``, one column per item.

    ``events`` has ``keys`` and the columns ``item``, ``time`` and ``value``;
    ``items`` names the output column of each item.  Every anchor is kept, and
    anchors have to be distinct rows.  To an anchor without a time all events
    of its key are equally near, and none lies in a window.  A tie in distance yields
    the largest value, and a NULL value holds its place: it yields NULL rather
    than the next nearest.  ``window`` restricts the events to a closed time
    range around the anchor; ``presence`` adds a column ``has_<name>`` per
    item that tells a NULL value from no event.  ``skip_null`` passes NULL
    values by, so the nearest value that is there is taken.
    """
    if skip_null:
        events = events.where(F.col("value").isNotNull())
    timed = anchors.where(F.col(at).isNotNull())
    listed = list(dict.fromkeys(items.values()))
    near = _neighbours(timed, events, keys, F.col(at), listed)
    columns = [f"`{c}`" for c in anchors.columns]
    value = "greatest(CASE WHEN n.wins_before THEN n.before.v END, CASE WHEN n.wins_after THEN n.after.v END)"
    found = _winners(near, F.col(at), window).selectExpr(
        *columns, f"transform(near, n -> {value}) AS _v", "transform(near, n -> n.wins_before OR n.wins_after) AS _found")
    picks = ["_v[{0}] AS `{1}`", "_found[{0}] AS `has_{1}`"][: 1 + presence]
    won = found.selectExpr(*columns, *[p.format(listed.index(i), n) for p in picks for n, i in items.items()])
    untimed = anchors.where(F.col(at).isNull())
    if window is None and untimed.isEmpty():
        return won
    if window is None:
        wanted = events.join(untimed.select(*keys).distinct(), list(keys), "left_semi")
        tied = wanted.groupBy(*keys, "item").agg(F.max("value").alias("v"))
        tied = untimed.join(tied, list(keys), "left").selectExpr(*columns, "item", "v", "item IS NOT NULL AS found")
    else:
        tied = untimed.selectExpr(*columns, "NULL AS item", "NULL AS v", "false AS found")
    picked = [F.max(F.when(F.col("item") == i, F.col("v"))).alias(n) for n, i in items.items()]
    if presence:
        own = {n: F.when(F.col("item") == i, F.col("found")) for n, i in items.items()}
        picked += [F.max(F.coalesce(h, F.lit(False))).alias(f"has_{n}") for n, h in own.items()]
    return won.unionByName(tied.groupBy(*anchors.columns).agg(*picked))


def nearest_rows(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    rank_at: str,
    window: tuple[Column, Column],
    items: Mapping[str, object],
    time_name: str = "charttime",
) -> DataFrame:
    """Long form of :func:`nearest_values`: events in ``window`` are ranked by
    distance to ``rank_at``, which may lie outside the window, and there is
    one row per anchor and time that holds a first rank.

    Anchors without events in the window keep one row with a NULL time.
    ``rank_at`` NULL makes every event of the window rank first.
    """
    anchors = pin(anchors)
    low, high = window
    # seen from any point, the nearest event of a range neighbours the point
    # of the range closest to it
    closest = F.greatest(F.least(F.col(rank_at), high), low)
    timed = anchors.where(F.col(rank_at).isNotNull())
    listed = list(dict.fromkeys(items.values()))
    near = _winners(_neighbours(timed, events, keys, closest, listed), F.col(rank_at), window)
    # an anchor's hits are in one row, at most two per item
    times = F.expr(
        "explode_outer(array_distinct(filter(flatten(transform(near, n -> array("
        "CASE WHEN n.wins_before THEN n.before.t END, CASE WHEN n.wins_after THEN n.after.t END))), t -> t IS NOT NULL)))")
    columns = [f"`{c}`" for c in anchors.columns]
    value = (
        "CASE WHEN n.wins_before AND n.before.t = _time THEN n.before.v"
        " WHEN n.wins_after AND n.after.t = _time THEN n.after.v END"
    )
    at_time = near.select(*anchors.columns, "near", times.alias("_time")).selectExpr(
        *columns, "_time", f"transform(near, n -> {value}) AS _v")
    hits = at_time.selectExpr(
        *columns, f"_time AS `{time_name}`", *[f"_v[{listed.index(i)}] AS `{n}`" for n, i in items.items()])
    untimed = anchors.where(F.col(rank_at).isNull())
    if untimed.isEmpty():
        return hits
    tied = interval_join(untimed, events, keys, low, high, "time")
    return hits.unionByName(tied.groupBy(*anchors.columns, F.col("time").alias(time_name)).agg(
        *[F.max(F.when(F.col("item") == i, F.col("value"))).alias(n) for n, i in items.items()]
    ))


def interval_join(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    low: Column,
    high: Column,
    event_time: str,
    how: str = "left",
    cell_micros: int = CELL_MICROS,
) -> DataFrame:
    """Anchors with the events of the same ``keys`` in [low, high].

    Time is cut into cells and the join key includes the cell, so that a key
    with many events is spread and only neighbours in time are compared; cells
    in which one key has very many events are divided.  A ``left`` join keeps
    every anchor without an event once; equal anchors are rows of their own.
    """
    keys = list(keys)
    values = [c for c in events.columns if c not in keys]
    if how != "inner":
        # written with a number, so that equal anchors are told apart
        anchors = pin(anchors.withColumn("_row", F.monotonically_increasing_id()))
    dense = dense_cells(events, keys, event_time, cell_micros)
    left = anchors.select("*", low.alias("_low"), high.alias("_high"))
    left = covered_cells(left, keys, "_low", "_high", cell_micros, dense, "_cell")
    right = with_cell(events, keys, event_time, cell_micros, dense, "_r_cell").select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *values, "_r_cell"
    )
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    on += [F.col("_cell") == F.col("_r_cell"), F.col(event_time).between(F.col("_low"), F.col("_high"))]
    found = left.join(right, on, "inner").select(*anchors.columns, *values)
    if how == "inner":
        return found
    # the numbers of anchors with an event are all that travels to find the others
    seen = left.join(right, on, "left_semi").select("_row").distinct()
    empty = anchors.join(seen, "_row", "left_anti")
    return found.unionByName(empty, allowMissingColumns=True).drop("_row")
