"""Row-position windows over long series without one task per series.

``Window.partitionBy(city)`` puts a whole city in one task; if one city holds a
third of all rows that task holds a third of the data. The helpers here keep
ROWS-frame semantics exactly but partition the work by ``(series, chunk)``:

1. :func:`with_position` gives every row its 0-based position in its series.
   Rows are counted per ``(series, time bucket)`` (a partial/final hash
   aggregate), the small count table gets running offsets, and the position is
   ``offset + row_number`` inside the bucket, a window over ``(series, bucket)``.
2. :func:`framed` cuts each series into chunks of ``chunk_rows`` positions and
   copies the last ``back`` rows of every chunk into the next one (and the first
   ``ahead`` rows into the previous one) as read-only halo rows. Any frame of at
   most ``back`` preceding / ``ahead`` following rows evaluated inside
   ``(series, chunk)`` then equals the same frame over the whole series.
3. :func:`carry_forward` / :func:`carry_backward` handle unbounded frames
   (last / first non-null value) as a two-level scan: per chunk, then across
   the chunk table.

Keys must be unique per ``(series, order)``; pass ``tiebreak`` otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
CHUNK = "_chunk"
HALO = "_halo"

DEFAULT_BUCKET_SECONDS = 7 * 86400
DEFAULT_CHUNK_ROWS = 1 << 16
DEFAULT_MOST_ROWS = 500_000         # rows of a (series, time bucket) that one task numbers


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL equals NULL, so rows with a NULL key stay; keeps the left keys."""
    names = {c: f"_right_{c}" for c in on}
    cond = None
    for c, r in names.items():
        one = F.col(c).eqNullSafe(F.col(r))
        cond = one if cond is None else cond & one
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def _epoch_seconds(order: str) -> Column:
    return F.unix_seconds(F.col(order).cast("timestamp"))


def is_derived(df: DataFrame) -> bool:
    """True when the plan aggregates or joins, i.e. re-running it costs more than
    reading its (smaller) result back."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(node in plan for node in ("Aggregate", "Join", "Window"))


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain scan, else its materialised copy (see
    :func:`is_derived`): for callers that read their input in several branches."""
    if is_derived(df):
        from ..session import materialize
        return materialize(df)
    return df


def _fine_buckets(df: DataFrame, keys: list[str], order: str, bucket_seconds: int, most_rows: int,
                  may_hash: bool) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that cut every (series, time bucket) of over ``most_rows`` rows into
    cells of time, sized by counted rows; and those columns in order.

    Each round counts the rows a cell and makes the cells of the buckets that are still too
    full several times narrower, down to a microsecond. Rows with one and the same time have
    no order of their own: they are dealt by a hash of the row, unless a tiebreak orders them."""
    from ..session import materialize
    width = bucket_seconds * 1_000_000
    t = F.unix_micros(F.col(order).cast("timestamp"))
    key = [*keys, "_bkt"]
    keyed = df.withColumn("_t", t).withColumn("_bkt", F.floor(F.col("_t") / F.lit(width)))
    row_hash = F.xxhash64(*df.columns)
    cells = None                                # (series, bucket, cell width, parts of one time)
    while True:
        if cells is None:
            cut = keyed.withColumn("_sub", F.lit(0).cast("long")).withColumn("_tie", F.lit(0).cast("long"))
        else:
            cut = join_null_safe(keyed, cells, key, "left")
            inside = F.col("_t") - F.col("_bkt") * F.lit(width)
            cut = (cut.withColumn("_sub", F.coalesce(F.floor(inside / F.coalesce("_cell", F.lit(width))), F.lit(0)))
                   .withColumn("_tie", F.coalesce(F.pmod(row_hash, F.col("_parts")), F.lit(0))).drop("_cell", "_parts"))
        out = cut.drop("_t"), ["_bkt", "_sub", "_tie"]
        full = materialize(cut.groupBy(*key, "_sub", "_tie").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_rows)
                           .groupBy(*key).agg(F.max("_n").alias("_n")))
        if not full.limit(1).count():
            return out
        was = full.withColumn("_cell", F.lit(width)).withColumn("_parts", F.lit(1).cast("long")) if cells is None else \
            join_null_safe(full, cells, key, "left").withColumn("_cell", F.coalesce("_cell", F.lit(width))) \
            .withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
        times = 4 * F.ceil(F.col("_n") / F.lit(most_rows))
        one = (F.col("_cell") <= 1) | F.col("_bkt").isNull()
        if not may_hash and not was.where(~one).limit(1).count():
            return out
        again = was.select(*key, F.greatest(F.floor(F.col("_cell") / times), F.lit(1)).alias("_cell"),
                           F.when(one & F.lit(may_hash), F.col("_parts") * times).otherwise(F.col("_parts")).alias("_parts"))
        if not was.where(F.col("_parts") < 1 << 20).limit(1).count():
            return out                          # equal rows, which no hash tells apart
        cells = materialize(again if cells is None else again.unionByName(
            join_null_safe(cells, again.select(*key), key, "left_anti")))


def with_position(df: DataFrame, by="city", order: str = "timestamp",
                  tiebreak: Sequence[str] = (), bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                  pos_col: str = POS, materialize: bool | None = None, most_rows: int = DEFAULT_MOST_ROWS) -> DataFrame:
    """Add ``pos_col`` = 0-based row position within each ``by`` series.

    The input feeds two branches (count table and rows). A derived input is
    written once to the shared checkpoint folder first (``materialize=None``
    decides by the plan), so its upstream aggregates and joins run once; a
    plain table scan is simply read twice.

    A bucket is one task's work. In a table of over ``most_rows`` rows, buckets with more
    than that are cut finer, by counted rows (dense or repeated times).
    """
    keys = _as_list(by)
    if materialize is None:
        materialize = is_derived(df)
    if materialize:
        from ..session import materialize as _write_once
        df = _write_once(df)
    if df.count() > most_rows:
        keyed, cell = _fine_buckets(df, keys, order, bucket_seconds, most_rows, not _as_list(tiebreak))
    else:
        keyed, cell = df.withColumn("_bkt", F.floor(_epoch_seconds(order) / F.lit(bucket_seconds))), ["_bkt"]
    counts = keyed.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, *cell).orderBy(order, *_as_list(tiebreak))
    return (join_null_safe(keyed, offsets, [*keys, *cell])
                 .withColumn(pos_col, F.col("_off") + F.row_number().over(inner) - 1)
                 .drop(*cell, "_off"))


def with_chunks(df: DataFrame, back: int, ahead: int = 0, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                pos_col: str = POS) -> tuple[DataFrame, int]:
    """Replicate halo rows so each chunk sees ``back``/``ahead`` neighbours."""
    size = max(int(chunk_rows), int(back), int(ahead), 1)
    pos = F.col(pos_col)
    chunk = F.floor(pos / F.lit(size))
    offset = pos % F.lit(size)
    copies = [F.struct(chunk.alias(CHUNK), F.lit(False).alias(HALO))]
    if back > 0:
        copies.append(F.when(offset >= F.lit(size - back),
                             F.struct((chunk + 1).alias(CHUNK), F.lit(True).alias(HALO))))
    if ahead > 0:
        copies.append(F.when((offset < F.lit(ahead)) & (chunk > 0),
                             F.struct((chunk - 1).alias(CHUNK), F.lit(True).alias(HALO))))
    arr = F.array(*copies)
    if len(copies) > 1:
        arr = F.array_compact(arr)
    out = df.withColumn("_cp", F.explode(arr)).select("*", "_cp.*").drop("_cp")
    return out, size


def framed(df: DataFrame, features: Callable[[Window], list[Column]], *, by="city",
           order: str = "timestamp", back: int = 0, ahead: int = 0,
           tiebreak: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
           bucket_seconds: int = DEFAULT_BUCKET_SECONDS, keep_position: bool = False,
           positioned: bool = False) -> DataFrame:
    """Evaluate ``features(w)`` where ``w`` orders each series by position.

    ``features`` receives a window spec partitioned by (series, chunk) and
    ordered by position; frames may reach at most ``back`` rows behind and
    ``ahead`` rows ahead. All returned columns share that one spec, so the
    plan sorts once.
    """
    keys = _as_list(by)
    base = df if positioned else with_position(df, keys, order, tiebreak, bucket_seconds)
    chunked, _ = with_chunks(base, back, ahead, chunk_rows)
    w = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    out = (chunked.select("*", *features(w))
                  .where(~F.col(HALO))
                  .drop(CHUNK, HALO))
    return out if keep_position or positioned else out.drop(POS)


def sliding(df: DataFrame, col: str, names: dict[tuple[int, str], str], *, shift: int = 1, by="city",
            order: str = "timestamp", tiebreak: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
            bucket_seconds: int = DEFAULT_BUCKET_SECONDS, positioned: bool = False) -> DataFrame:
    """Statistics of the n rows that end ``shift`` rows back, in time that does not grow with n.

    ``names`` maps (n, statistic) to an output column; statistics are mean, std, min and max.
    A value is NULL until n values are there. Positions are cut into blocks of n rows; any n
    rows in a row are the end of one block and the beginning of the next. Growing frames give
    the count, sum, centred square sum, minimum and maximum of every beginning and (over
    descending order) of every end, one step a row, and a row combines the two that it needs.
    Nothing is subtracted, so no digits cancel: square sums join as those of two samples do."""
    keys = _as_list(by)
    sizes = sorted({n for n, _ in names})
    base = df if positioned else with_position(df, keys, order, tiebreak, bucket_seconds)
    rows, _ = with_chunks(base, max(sizes) - 1 + shift, 0, chunk_rows)
    x = F.col(col).cast("double")
    for n in sizes:
        block = Window.partitionBy(*keys, CHUNK, "_blk").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_blk", F.floor(F.col(POS) / F.lit(n)))

        def upto(w):
            return F.struct(F.count(x).over(w).alias("n"), F.sum(x).over(w).alias("s"),
                            (F.var_pop(x).over(w) * F.count(x).over(w)).alias("m2"),
                            F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi"))

        rows = rows.select("*", upto(block.orderBy(POS)).alias(f"_begin_{n}"))
        rows = rows.select("*", upto(block.orderBy(F.col(POS).desc())).alias(f"_end_{n}")).drop("_blk")
    series = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    rows = rows.select("*", *[F.lag(f"_begin_{n}", shift).over(series).alias(f"_b_{n}") for n in sizes],
                       *[F.lag(f"_end_{n}", n - 1 + shift).over(series).alias(f"_e_{n}") for n in sizes])

    def value(n: int, stat: str) -> Column:
        b, e = F.col(f"_b_{n}"), F.col(f"_e_{n}")
        one = (F.col(POS) - F.lit(n - 1 + shift)) % F.lit(n) == 0          # the n rows are one block
        mean = lambda t: t["s"] / t["n"]
        if stat == "mean":
            whole, two = mean(b), (e["s"] + b["s"]) / F.lit(float(n))
        elif stat == "std":
            gap = mean(b) - mean(e)
            joint = e["m2"] + b["m2"] + gap * gap * (e["n"] * b["n"] / F.lit(float(n)))
            # one value has no spread
            per = F.lit(float(n - 1)) if n > 1 else F.lit(None).cast("double")
            whole, two = F.sqrt(b["m2"] / per), F.sqrt(joint / per)
        else:
            pick, f = ("lo", F.least) if stat == "min" else ("hi", F.greatest)
            whole, two = b[pick], f(e[pick], b[pick])
        return F.when(one & (b["n"] == n), whole).when(~one & (e["n"] + b["n"] == n), two)

    kept = [c for c in base.columns]
    out = rows.where(~F.col(HALO)).select(*kept, *[value(n, s).alias(name) for (n, s), name in names.items()])
    return out if positioned else out.drop(POS)


def _carry(df: DataFrame, cols: Sequence[str], by, forward: bool,
           chunk_rows: int, order: str, tiebreak, bucket_seconds, positioned: bool) -> DataFrame:
    keys = _as_list(by)
    base = df if positioned else with_position(df, keys, order, tiebreak, bucket_seconds)
    size = max(int(chunk_rows), 1)
    base = base.withColumn(CHUNK, F.floor(F.col(POS) / F.lit(size)))
    pick = F.max_by if forward else F.min_by
    # last (first) non-null value of each chunk
    per_chunk = base.groupBy(*keys, CHUNK).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_v_{c}") for c in cols])
    # Both directions use growing frames (unbounded preceding): Spark evaluates
    # those incrementally, whereas an unbounded-following frame is recomputed for
    # every row (quadratic). The backward scan runs over descending order.
    agg = F.last
    if forward:
        wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    else:
        wc = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, CHUNK, *[agg(f"_v_{c}", ignorenulls=True).over(wc).alias(f"_k_{c}")
                                               for c in cols])
    if forward:
        wi = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    else:
        wi = Window.partitionBy(*keys, CHUNK).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(base, carried, [*keys, CHUNK], "left")
    filled = [F.coalesce(agg(c, ignorenulls=True).over(wi), F.col(f"_k_{c}")).alias(f"_f_{c}") for c in cols]
    out = joined.select("*", *filled)
    for c in cols:
        out = out.withColumn(c, F.col(f"_f_{c}")).drop(f"_f_{c}", f"_k_{c}")
    out = out.drop(CHUNK)
    return out if positioned else out.drop(POS)


def carry_forward(df: DataFrame, cols: Sequence[str], by="city", order: str = "timestamp",
                  tiebreak: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS, positioned: bool = False) -> DataFrame:
    """Replace NULLs with the last earlier non-null value of the series (ffill)."""
    return _carry(df, _as_list(cols), by, True, chunk_rows, order, tiebreak, bucket_seconds, positioned)


def carry_backward(df: DataFrame, cols: Sequence[str], by="city", order: str = "timestamp",
                   tiebreak: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
                   bucket_seconds: int = DEFAULT_BUCKET_SECONDS, positioned: bool = False) -> DataFrame:
    """Replace NULLs with the next later non-null value of the series (bfill)."""
    return _carry(df, _as_list(cols), by, False, chunk_rows, order, tiebreak, bucket_seconds, positioned)


def carry_both(df: DataFrame, cols: Sequence[str], by="city", order: str = "timestamp",
               tiebreak: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
               bucket_seconds: int = DEFAULT_BUCKET_SECONDS, positioned: bool = False) -> DataFrame:
    """Add ``{c}_ffill`` and ``{c}_bfill`` for every column in one two-level scan.

    One aggregate per chunk (last and first non-null), one window pass over the
    small chunk table (both directions share its sort), one join back and one
    window pass inside the chunks: half the shuffles of ffill followed by bfill.
    """
    keys = _as_list(by)
    cols = _as_list(cols)
    base = df if positioned else with_position(df, keys, order, tiebreak, bucket_seconds)
    size = max(int(chunk_rows), 1)
    base = base.withColumn(CHUNK, F.floor(F.col(POS) / F.lit(size)))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(POS))
    per_chunk = base.groupBy(*keys, CHUNK).agg(
        *[F.max_by(F.col(c), at(c)).alias(f"_l_{c}") for c in cols],
        *[F.min_by(F.col(c), at(c)).alias(f"_f_{c}") for c in cols])
    # growing frames only (see _carry): backward = forward over descending order
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, CHUNK,
                               *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_kf_{c}") for c in cols],
                               *[F.last(f"_f_{c}", ignorenulls=True).over(after).alias(f"_kb_{c}") for c in cols])
    upto = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys, CHUNK).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(base, carried, [*keys, CHUNK], "left")
    fwd = joined.select("*", *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_kf_{c}")).alias(f"{c}_ffill")
                               for c in cols])
    out = fwd.select(*base.columns, *[f"{c}_ffill" for c in cols],
                     *[F.coalesce(F.last(c, ignorenulls=True).over(onward), F.col(f"_kb_{c}")).alias(f"{c}_bfill")
                       for c in cols]).drop(CHUNK)
    return out if positioned else out.drop(POS)
