"""Frame sequences: numbering, pieces with halo, runs, nearest-value fill.

Every sequence (video, identity) may be arbitrarily long, and one of them may
hold a large share of all rows. None of the operators below therefore puts a
whole sequence into one task: sequences are cut into *pieces* of ``PIECE``
consecutive frames, rows next to a cut are copied to the neighbour piece (the
halo), and what has to travel further than a halo (run borders, nearest valid
values, row offsets) travels as one small summary row per piece.

Longer expressions are written as SQL text: it reads well for window clauses, and a plan of
hundreds of columns is built in a fraction of the calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ethospark.session import scratch_folder

PIECE = 1 << 14


def listed(names: Sequence[str]) -> str:
    """Column names for SQL text."""
    return ", ".join(f"`{n}`" for n in names)


def piece_sql(order: str, piece: int = PIECE) -> str:
    return f"CAST(floor(({order}) / {piece}) AS BIGINT)"


def piece_of(order: Column | str, piece: int = PIECE) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(piece)).cast("bigint")


def with_halo(
    df: DataFrame, order: str, before: int, after: int, piece: int = PIECE
) -> DataFrame:
    """Copy each row to every piece that can see it from ``before``/``after`` frames away.

    Adds ``_piece``; a row belongs to the piece where ``piece_of(order) == _piece``.
    """
    first = piece_sql(f"`{order}` - {after}", piece)
    last = piece_sql(f"`{order}` + {before}", piece)
    return df.selectExpr("*", f"explode(sequence({first}, {last})) AS _piece")


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int,
    after: int,
    make: Callable[[WindowSpec], dict[str, Column]],
    piece: int = PIECE,
) -> DataFrame:
    """Add columns that look at most ``before``/``after`` frames around a row.

    ``make`` gets a window spec ordered by ``order`` and returns the new columns; it
    bounds them with ``rangeBetween`` (frame distance), so gaps in the frames are safe.
    """
    spec = Window.partitionBy(*keys, "_piece").orderBy(order)
    halo = with_halo(df, order, before, after, piece)
    wide = halo.select("*", *[c.alias(n) for n, c in make(spec).items()])
    return wide.filter(f"{piece_sql(f'`{order}`', piece)} = _piece").drop("_piece")


def with_neighbours(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], frame: str = "frame", piece: int = PIECE
) -> DataFrame:
    """Add ``before``/``after``: structs of ``columns`` one frame away, NULL without such a row."""
    spec = f"OVER (PARTITION BY {listed(keys)}, _piece ORDER BY `{frame}`)"
    packed = f"struct(`{frame}`, {listed(columns)})"
    halo = with_halo(df, frame, 1, 1, piece).selectExpr(
        "*", f"lag({packed}) {spec} AS _prev", f"lead({packed}) {spec} AS _next"
    )
    return halo.filter(f"{piece_sql(f'`{frame}`', piece)} = _piece").selectExpr(
        "*",
        f"CASE WHEN _prev.`{frame}` = `{frame}` - 1 THEN _prev END AS before",
        f"CASE WHEN _next.`{frame}` = `{frame}` + 1 THEN _next END AS after",
    ).drop("_piece", "_prev", "_next")


def at_offset(column: Column | str, spec: WindowSpec, offset: int) -> Column:
    """Value exactly ``offset`` frames away, NULL when that frame has no row."""
    column = F.col(column) if isinstance(column, str) else column
    return F.first(column).over(spec.rangeBetween(offset, offset))


def number_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: str,
    name: str = "frame",
) -> DataFrame:
    """0-based dense row number per ``keys`` in ``order``.

    ``bucket`` (SQL text) must be a coarse, order-preserving image of the first order column.
    Rows are numbered inside a bucket and shifted by the row count of the earlier buckets, so
    no task sorts a whole sequence.
    """
    key = listed(keys)
    df = df.selectExpr("*", f"{bucket} AS _bucket")
    starts = (
        df.groupBy(*keys, "_bucket").agg(F.expr("count(1) AS _rows"))
        .selectExpr(
            *[f"`{k}`" for k in keys], "_bucket",
            f"""coalesce(sum(_rows) OVER (PARTITION BY {key} ORDER BY _bucket
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _start""",
        )
    )
    numbered = df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {key}, _bucket ORDER BY {listed(order)}) - 1 AS _local"
    )
    return (
        numbered.join(starts, [*keys, "_bucket"])
        .selectExpr("*", f"CAST(_start + _local AS INT) AS `{name}`")
        .drop("_bucket", "_local", "_start")
    )


def spine(
    lengths: DataFrame, keys: Sequence[str], count: str = "num_frames", piece: int = PIECE
) -> DataFrame:
    """One row per frame 0..count-1; pieces are exploded first so a long video spreads out."""
    pieces = lengths.filter(f"`{count}` > 0").selectExpr(
        "*", f"explode(sequence(0L, {piece_sql(f'`{count}` - 1', piece)})) AS _piece"
    )
    last = f"least(CAST(`{count}` - 1 AS BIGINT), (_piece + 1) * {piece} - 1)"
    return (
        pieces.repartition(*keys, "_piece")
        .selectExpr(*[f"`{k}`" for k in keys], f"explode(sequence(_piece * {piece}, {last})) AS _f")
        .selectExpr(*[f"`{k}`" for k in keys], "CAST(_f AS INT) AS frame")
    )


def seeded_draw(seed: int, columns: Sequence[str]) -> Column:
    """A seeded random order of rows, as text: digest of the seed and the columns that tell rows apart."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in columns]))


def lookup_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", spread: int = 16
) -> DataFrame:
    """Join per-video attributes to frames without piling a hot video up in one task.

    The attribute side is copied ``spread`` times and the frame side salted. Spark still
    broadcasts the attribute side by itself while its size estimate allows.
    """
    salted = small.selectExpr("*", f"explode(sequence(0, {spread - 1})) AS _salt")
    rows = big.selectExpr("*", f"pmod(hash({listed(_salt_columns(big, keys))}), {spread}) AS _salt")
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")


def _salt_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """What tells rows of one key apart: the frame or start if there is one, else simple columns."""
    others = [(n, kind) for n, kind in df.dtypes if n not in keys]
    times = [n for n, _ in others if n in ("frame", "sample_frame", "start", "_i")]
    return times or [n for n, kind in others if not kind.startswith(("map", "array", "struct"))] or list(keys)


def runs_of_intervals(
    df: DataFrame,
    keys: Sequence[str],
    state: Sequence[str] = ("state",),
    start: str = "start",
    end: str = "end",
    piece: int = PIECE,
) -> DataFrame:
    """Merge touching intervals of equal state into maximal runs.

    Input intervals must not overlap within ``keys``. Output: keys, state columns, ``start``,
    ``end`` (inclusive), ``duration``, and for each state column ``prev_*`` / ``next_*``: the
    state of the run that touches on that side (NULL where nothing touches).
    """
    keys, state = list(keys), list(state)
    key = listed(keys)
    here = f"OVER (PARTITION BY {key}, _piece ORDER BY start)"

    def merged(rows: DataFrame, over: str, ways: Sequence[str]) -> DataFrame:
        """Rows that continue the one before become one: its first row, with the end of its last.

        Only windows of one order, so a part is sorted once and no table of runs is held beside it.
        """
        before = " AND ".join([f"lag(end) {over} + 1 = start", *[f"lag(`{s}`) {over} <=> `{s}`" for s in state]])
        after = " AND ".join([f"lead(start) {over} = end + 1", *[f"lead(`{s}`) {over} <=> `{s}`" for s in state]])
        ends = rows.selectExpr(
            "*", f"NOT coalesce({before}, FALSE) AS _head", f"NOT coalesce({after}, FALSE) AS _tail"
        ).filter("_head OR _tail")
        of_last = ["end", *ways]
        kept = [f"`{c}`" for c in ends.columns if c not in of_last]
        return ends.selectExpr(
            *kept, *[f"CASE WHEN _tail THEN `{c}` ELSE lead(`{c}`) {over} END AS `{c}`" for c in of_last]
        ).filter("_head")

    def touching(over: str, first: str, last: str, known: bool) -> list[str]:
        out = []
        for s in state:
            prev = f"CASE WHEN lag(end) {over} + 1 = start THEN lag(`{s}`) {over} END"
            following = f"CASE WHEN lead(start) {over} = end + 1 THEN lead(`{s}`) {over} END"
            if known:
                prev = f"CASE WHEN {first} THEN {prev} ELSE `prev_{s}` END"
                following = f"CASE WHEN {last} THEN {following} ELSE `next_{s}` END"
            out += [f"{prev} AS `prev_{s}`", f"{following} AS `next_{s}`"]
        return out

    plain = [f"`{c}`" for c in [*keys, *state]]
    given = df.selectExpr(
        *plain, f"`{start}` AS start", f"`{end}` AS end", f"{piece_sql(f'`{start}`', piece)} AS _piece"
    )
    local = merged(given, here, []).selectExpr(
        *plain, "_piece", "start", "end",
        f"row_number() {here} = 1 AND _piece > 0 AS _first",
        f"lead(start) {here} IS NULL AND {piece_sql('end + 1', piece)} > _piece AS _last",
        *touching(here, "", "", False),
    )
    # Only the first and last run of a piece can continue in another piece (frames start at 0, so
    # nothing precedes piece 0). Those edge runs, at most two per piece, meet in one group per key
    # and are joined there; all others stay in a group of their piece, where they are final.
    side = "CASE WHEN _first OR _last THEN -1 ELSE _piece END AS _side"
    across = f"OVER (PARTITION BY {key}, _side ORDER BY start)"
    sided = local.selectExpr("*", side).selectExpr(
        *plain, "_side", "start", "end", *touching(across, "_first", "_last", True)
    )
    keep = [c for s in state for c in (f"`prev_{s}`", f"`next_{s}`")]
    return merged(sided, across, [f"next_{s}" for s in state]).selectExpr(
        *plain[: len(keys)], "start", "end", *plain[len(keys):], *keep, "end - start + 1 AS duration",
    )


def runs(
    df: DataFrame, keys: Sequence[str], state: Sequence[str] = ("state",), frame: str = "frame",
    piece: int = PIECE,
) -> DataFrame:
    """Maximal runs of consecutive frames with equal state (see ``runs_of_intervals``)."""
    return runs_of_intervals(df, keys, state, frame, frame, piece)


def position_in_key(
    df: DataFrame, keys: Sequence[str], order: str, name: str, piece: int = PIECE
) -> DataFrame:
    """0-based position of each row within its key, counted piece by piece."""
    return number_frames(df, keys, [order], piece_sql(f"`{order}`", piece), name)


def running_before(
    df: DataFrame, keys: Sequence[str], order: str, value: str, how: str, name: str, piece: int = PIECE
) -> DataFrame:
    """Add ``sum``/``min``/``max`` of ``value`` (SQL text) over all earlier rows of the key.

    ``order`` is an integer column; earlier pieces enter as one value each. NULL on first rows.
    """
    key = listed(keys)
    rows = df.selectExpr("*", f"{value} AS _v", f"{piece_sql(f'`{order}`', piece)} AS _piece")
    earlier = f"OVER (PARTITION BY {key} ORDER BY _piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    pieces = rows.groupBy(*keys, "_piece").agg(F.expr(f"{how}(_v) AS _part")).selectExpr(
        *[f"`{k}`" for k in keys], "_piece", f"{how}(_part) {earlier} AS _outer"
    )
    here = f"""OVER (PARTITION BY {key}, _piece ORDER BY `{order}`
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    joined = rows.selectExpr("*", f"{how}(_v) {here} AS _inner").join(pieces, [*keys, "_piece"])
    both = {"sum": "coalesce(_outer + _inner, _outer, _inner)", "min": "least(_outer, _inner)",
            "max": "greatest(_outer, _inner)"}[how]
    return joined.selectExpr("*", f"{both} AS `{name}`").drop("_v", "_piece", "_outer", "_inner")


def nearest_value(
    df: DataFrame, keys: Sequence[str], value: str, frame: str = "frame", piece: int = PIECE
) -> DataFrame:
    """Fill NULLs of ``value`` from the nearest frame that has one; ties take the earlier.

    Adds ``<value>_filled`` (NULL only when the whole sequence has no value).
    """
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    rows = df.withColumn("_piece", piece_of(frame, piece)).withColumn("_known", known)
    summary = rows.groupBy(*keys, "_piece").agg(
        F.min("_known").alias("_lo"), F.max("_known").alias("_hi")
    )
    across = Window.partitionBy(*keys).orderBy("_piece")
    borders = summary.select(
        *keys, "_piece",
        F.last("_hi", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True)
        .over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    here = Window.partitionBy(*keys, "_piece").orderBy(frame)
    local = rows.withColumns({
        "_prev": F.last("_known", ignorenulls=True)
        .over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first("_known", ignorenulls=True)
        .over(here.rowsBetween(0, Window.unboundedFollowing)),
    })
    joined = local.join(borders, [*keys, "_piece"], "left").withColumns({
        "_prev": F.coalesce("_prev", "_before"),
        "_next": F.coalesce("_next", "_after"),
    })
    back, ahead = F.col(frame) - F.col("_prev.f"), F.col("_next.f") - F.col(frame)
    chosen = (
        F.when(F.col("_prev").isNull(), F.col("_next.v"))
        .when(F.col("_next").isNull(), F.col("_prev.v"))
        .when(back <= ahead, F.col("_prev.v"))
        .otherwise(F.col("_next.v"))
    )
    return joined.withColumn(f"{value}_filled", chosen).drop(
        "_piece", "_known", "_before", "_after", "_prev", "_next"
    )


def frames_of(
    intervals: DataFrame, start: str = "start", end: str = "end", name: str = "frame", piece: int = PIECE
) -> DataFrame:
    """One row per frame of each interval (both ends included); ``start``/``end`` are dropped.

    Long intervals are cut into pieces first, so one interval is not one huge generator row.
    """
    others = [c for c in intervals.columns if c not in (start, end, name)]
    cut = intervals.filter(f"`{start}` <= `{end}`").selectExpr(
        *[f"`{c}`" for c in others], f"CAST(`{end}` AS INT) AS _to",
        f"explode(sequence(CAST(`{start}` AS INT), CAST(`{end}` AS INT), {piece})) AS _from",
    )
    return cut.selectExpr(
        *[f"`{c}`" for c in others],
        f"explode(sequence(_from, least(_to, _from + {piece - 1}))) AS `{name}`",
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    cell: int = 1024,
) -> DataFrame:
    """Pairs of intervals that share at least one frame (inner join).

    Both sides are spread over cells of ``cell`` frames and joined on (keys, cell), so a hot
    video is many small joins. A pair is kept only in the first cell both reach, hence once.
    """
    (ls, le), (rs, re) = left_range, right_range

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn(
            "_cell", F.explode(F.sequence(piece_of(start, cell), piece_of(end, cell)))
        )

    joined = spread(left, ls, le).join(spread(right, rs, re), [*keys, "_cell"])
    first_shared = piece_of(F.greatest(F.col(ls), F.col(rs)), cell)
    meets = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))
    return joined.filter(meets & (first_shared == F.col("_cell"))).drop("_cell")


def smallest_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, spread: Column
) -> DataFrame:
    """The first ``n`` rows per key. Each ``spread`` part of a key is cut to ``n`` rows first."""
    parts = Window.partitionBy(*keys, "_part").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    few = df.withColumn("_part", spread).withColumn("_rank", F.row_number().over(parts))
    few = few.filter(F.col("_rank") <= n)
    return few.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop(
        "_part", "_rank"
    )


def running_total(df: DataFrame, order: Sequence[str], size: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``size`` over all rows before, in one global order, by ranges.

    The rows are parted by ranges of the order and written; the driver adds up one number per part.
    """
    parted = _written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted((r["_part"], r["_sum"]) for r in parted.groupBy("_part").agg(F.sum(size).alias("_sum")).collect())
    starts = list(accumulate((n for _, n in sums), initial=0))
    start = F.create_map(*[F.lit(x) for (part, _), s in zip(sums, starts) for x in (part, s)]) if sums else F.lit(None)
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    total = F.element_at(start, F.col("_part")) + inside if sums else F.lit(0).cast("long")
    return parted.withColumn(name, total).drop("_part")


MIDDLE_VALUES = 4096  # different values that are ordered in one place


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, cells: int = 1024, few: int = MIDDLE_VALUES
) -> DataFrame:
    """Median of ``value`` per key, without gathering a key's values in one place.

    Equal values are counted together and written once. The range of a key is cut into cells, the cell that
    holds a middle rank becomes the new range, from its smallest to its largest value, until it has at
    most ``few`` different values; only these are ordered. The driver starts one job per refinement: for
    any spread of values short of clusters within clusters that is one or two.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value"))
    values = _written(counted.agg(F.count(F.lit(1)).alias("_n")), "median-values")
    ends = values.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    middle = F.array_distinct(F.array(F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)))
    wanted = ends.select(*keys, F.explode(middle).alias("_rank"), F.lit(0).cast("bigint").alias("_before"), "_low", "_high")

    def inside(wanted: DataFrame) -> DataFrame:
        return lookup_join(values, wanted, keys, "inner").filter(F.col("_value").between(F.col("_low"), F.col("_high")))

    while True:
        share = (F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        cell = F.when(F.col("_high") > F.col("_low"), F.floor(share * cells)).otherwise(0).alias("_cell")
        counts = inside(wanted).groupBy(*keys, "_rank", "_before", cell).agg(
            F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_values"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
        )
        earlier = Window.partitionBy(*keys, "_rank").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        here = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
        wanted = _written(placed.filter(here).select(*keys, "_rank", "_before", "_low", "_high", "_values"), "median-cells")
        if wanted.filter(F.col("_values") > few).isEmpty():
            break
        wanted = wanted.drop("_values")
    ordered = Window.partitionBy(*keys, "_rank").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside(wanted).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(ordered), F.lit(0)))
    found = ranked.filter((F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_n")))
    return found.groupBy(*keys).agg(F.avg("_value").alias("median"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
