"""Penalised change points of daily series: a fold of each daily array over a state array (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n * Q of a series up to which whole numbers of 64 bits hold every product; beyond, decimals of 38 digits do.
NARROW = 4e18
#: Days of the fold between two choices of the prefixes that may still win.
STRIDE = 8


def daily_totals(df: DataFrame, key: Column, at: Column, value: Column) -> DataFrame:
    """(key, day, x): the sum of whole-number values per key and day (days since 1970) over the rows where time and value are known.

    A hot key's rows are summed in each task before they are shuffled. A null key is a key.
    """
    own = df.select(key.alias("key"), F.unix_date(F.to_date(at)).alias("day"), value.cast("bigint").alias("x"))
    return own.where("day is not null and x is not null").groupBy("key", "day").agg(F.sum("x").alias("x"))


def _let(name: str, value: str, body: str) -> str:
    """An expression with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _ratio(n: str, s: str, q: str, low: str, kind: str) -> str:
    """1 + floor((n * q - s * s) / low)."""
    top = f"({n} * {q} - {s} * {s})"
    return f"(1 + {top} div {low})" if kind == "bigint" else f"(1 + ({top} - {top} % {low}) / {low})"


def _log(v: str) -> str:
    return f"floor(1000D * ln(cast({v} as double)))"


def _between(a: str, b: str, kind: str) -> tuple[str, str, str]:
    """n, s and q of the days after point a up to point b."""
    whole = "({b}.at - {a}.at)" if kind == "bigint" else "cast({b}.at - {a}.at as decimal(38, 0))"
    return whole.format(a=a, b=b), f"({b}.s - {a}.s)", f"({b}.q - {a}.q)"


def _segments(days: str, least: int, penalty: int, kind: str) -> str:
    """The best segments of the array ``days`` as SQL on arrays: the fold, then the way back.

    The state array has an element for each prefix: its length (at), sums (s, q), and one number (best) of base r = days + 2 with three digits: the
    best cost, its number of segments, and the prefix before its last segment. Numbers compare as the three do. The next day's
    element is the least number over the whole prefix as one segment and over all prefixes that leave room for ``least`` days on both sides
    (enter: what such a segment adds to, with its own place as last digit). Days too close to the end to start a segment get no costs.

    The fold goes in strides of w days, at most ``least``, so that no day of a stride can be the start of a segment that ends in it; a fold copies
    its state at every step. Before a stride, prefixes that can't win on any of its days are left out, exactly: a segment of
    n days whose squared deviations sum to D has, t days later, at least D and so at least (n + t) * g as cost, with g = floor(1000 * ln(1 + floor(D / (n + w)))).
    On the other side every day's best is at most what the whole prefix or the last day's winner cost there (most: the largest of those less t * h,
    with h the winner's cost a day). So prefix a is out if enter + n * g - w * max(0, h - g) > most.
    """
    zero, w = f"cast(0 as {kind})", min(STRIDE, least)
    n, s, q = _between("a", "b", kind)
    spread = _ratio(n, s, q, f"({n} * {n})", kind)
    cost = f"cast((b.at - a.at) * {_log(spread)} as bigint)"
    entered = f"a.enter + rr * {cost}"
    start = f"array(named_struct('at', 0L, 's', {zero}, 'q', {zero}, 'best', 0L, 'enter', r))"
    end = "f[size(f) - 1]"
    known = "cast(o.at as int)"

    # the points of a stride, and its days' elements: from the whole prefix, the prefixes kept, and those that get room within the stride
    last = "p[size(p) - 1]"
    points = f"slice(aggregate(slice({days}, k * {w} + 1, {w}), array(named_struct('at', o.at, 's', o.s, 'q', o.q)), (p, x) -> p || array(named_struct('at', {last}.at + 1L, 's', cast({last}.s + x as {kind}), 'q', cast({last}.q + cast(x as {kind}) * x as {kind})))), 2, {w})"
    oldest = f"greatest({least}, {known} - {least - 1})"
    recent = f"slice(f, {oldest} + 1, {w})"
    room = f"slice(recent, 1, greatest(cast(b.at as int) - {least - 1} - {oldest}, 0))"
    idle = f"b.at > size({days}) - {least} and b.at < size({days})"
    step = f"if({idle}, 0L, aggregate({room}, aggregate(kept, {_let('a', 'f[0]', entered)}, (m, a) -> least(m, {entered})), (m, a) -> least(m, {entered})))"
    state = _let("m", step, f"named_struct('at', b.at, 's', b.s, 'q', b.q, 'best', m, 'enter', m - m % r + r + b.at + rr * {penalty}L)")

    # the prefixes kept
    n0, s0, q0 = _between("a", "o", kind)
    low = _log(_ratio(n0, s0, q0, f"({n0} * ({n0} + {w}))", kind))
    bound = _let("g", low, f"a.enter + rr * ((o.at - a.at) * g - {w}L * greatest(0L, h - g))")
    whole, winner = _let("a", "f[0]", entered), _let("a", "win", entered)
    most = f"array_max(transform(stride, b -> least({whole}, {winner}) - rr * (b.at - o.at) * h))"
    ready = f"slice(f, {least + 1}, greatest({known} - {2 * least - 1}, 0))"
    h = "cast((o.best - win.enter) div rr div (o.at - win.at) as bigint)"
    kept = f"if(o.at < {2 * least}, {ready}, {_let('win', 'f[cast(o.best % r as int)]', _let('h', h, _let('most', most, f'filter({ready}, a -> {bound} <= most)')))})"
    days_of = _let("kept", kept, _let("recent", recent, f"f || transform(stride, b -> {state})"))
    fold = f"aggregate(sequence(0, (size({days}) - 1) div {w}), {start}, (f, k) -> {_let('o', end, _let('stride', points, days_of))})"

    parts = f"{end}.best div r % r"
    hop = _let("a", "f[cast(w.at as int)].best % r", "named_struct('at', a, 'way', array(named_struct('a', a, 'b', w.at)) || w.way)")
    back = f"aggregate(sequence(1L, {parts}), named_struct('at', {end}.at, 'way', cast(array() as array<struct<a: bigint, b: bigint>>)), (w, k) -> {hop}, w -> w.way)"
    named = f"named_struct('after', a.at, 'n_days', b.at - a.at, 'total', cast(b.s - a.s as bigint), 'spread', cast({spread} as bigint), 'cost', {cost}, 'n_segments', {parts}, 'best_cost', {end}.best div rr)"
    ends = _let("b", "f[cast(c.b as int)]", named)
    segments = _let("f", fold, f"transform({back}, c -> {_let('a', 'f[cast(c.a as int)]', ends)})")
    return _let("r", f"cast(size({days}) + 2 as bigint)", _let("rr", "r * r", segments))


def change_points(daily: DataFrame, least: int = 14, penalty: int = 40_000) -> DataFrame:
    """(key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost) of every key's best segments.

    daily: (key, day, x), a row for each key and day at most, as ``daily_totals`` gives it; days without a row between a key's first and
    last one count 0. Segments have ``least`` days or more, but a shorter series is one segment. cost, of n days with sum S and sum of
    squares Q: n * floor(1000 * ln(V)) with V = 1 + floor((n * Q - S * S) / (n * n)); the sum of the costs plus ``penalty`` for each
    cut is least. Ties: fewest segments, then earliest starts, compared from the last segment backwards. An empty table has no rows;
    a null key is a key; a null x counts 0.

    Whole numbers throughout but for the logarithm: 64 bits where n * Q leaves room, decimals of 38 digits for the other
    series; what leaves those, or totals and spreads that leave a long, raises. A key's series is one array with an element for a
    day, so a task holds days and never rows; the fold takes time with the square of the days.
    """
    pairs = daily.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", F.coalesce("x", F.lit(0)).alias("x")))).alias("pairs"))
    filled = F.expr("flatten(transform(pairs, (p, i) -> array(p.x) || array_repeat(0L, coalesce(get(pairs, i + 1).day - p.day - 1, 0))))")
    series = pairs.select("key", F.expr("pairs[0].day").cast("bigint").alias("first"), filled.alias("days"))
    wide = F.expr(f"size(days) * aggregate(days, 0D, (t, x) -> t + cast(x as double) * x) >= {NARROW}D")
    best = F.when(wide, F.expr(_segments("days", least, penalty, "decimal(38, 0)"))).otherwise(F.expr(_segments("days", least, penalty, "bigint")))
    rows = series.select("key", "first", F.posexplode_outer(best).alias("k", "g"))
    return rows.select("key", (F.col("k") + 1).alias("segment_no"), (F.col("first") + F.col("g.after")).alias("first_day"), *(f"g.{c}" for c in ("n_days", "total", "spread", "cost", "n_segments", "best_cost")))


def op12_change_points(spark, sf_dir: str) -> DataFrame:
    """Segments of every vendor's daily quantity."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    daily = daily_totals(lines, F.col("vendor_id"), F.col("shipped_at"), F.col("quantity"))
    return change_points(daily).withColumnRenamed("key", "vendor_id")


OP12_SQL = """
WITH RECURSIVE day AS (
  SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS d, CAST(sum(quantity) AS HUGEINT) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), grid AS (SELECT vendor_id, first, unnest(range(first, last + 1)) AS d FROM (SELECT vendor_id, min(d) AS first, max(d) AS last FROM day GROUP BY ALL)
), point AS (
  SELECT g.vendor_id, g.first, g.d - g.first + 1 AS pos, sum(coalesce(x, 0)) OVER w AS s, sum(coalesce(x * x, 0)) OVER w AS q
  FROM grid g LEFT JOIN day ON g.vendor_id IS NOT DISTINCT FROM day.vendor_id AND g.d = day.d WINDOW w AS (PARTITION BY g.vendor_id ORDER BY g.d)
), series AS MATERIALIZED (
  SELECT vendor_id, first, list({'pos': pos, 's': CAST(s AS HUGEINT), 'q': CAST(q AS HUGEINT)} ORDER BY pos) AS p FROM point GROUP BY ALL
), fold AS (
  SELECT vendor_id, first, p, CAST(1 AS BIGINT) AS j,
    [{'cost': CAST(0 AS BIGINT), 'parts': CAST(0 AS BIGINT), 'pred': CAST(-1 AS BIGINT), 'pos': CAST(0 AS BIGINT), 's': CAST(0 AS HUGEINT), 'q': CAST(0 AS HUGEINT)}] AS f FROM series
  UNION ALL
  SELECT vendor_id, first, p, j + 1, list_append(f, {'cost': m.cost, 'parts': m.parts, 'pred': m.pred, 'pos': j, 's': p[j].s, 'q': p[j].q})
  FROM (
    SELECT *, list_min(list_transform(list_filter(f, lambda a: a.pos = 0 OR (a.pos >= 14 AND a.pos <= j - 14)), lambda a: {
      'cost': a.cost + CASE WHEN a.pos = 0 THEN 0 ELSE 40000 END + CAST((j - a.pos) * floor(1000 * ln(CAST(1 + ((j - a.pos) * (p[j].q - a.q) - (p[j].s - a.s) * (p[j].s - a.s)) // ((j - a.pos) * (j - a.pos)) AS DOUBLE))) AS BIGINT),
      'parts': a.parts + 1, 'pred': a.pos})) AS m
    FROM fold WHERE j <= len(p)
  )
), back AS (
  SELECT vendor_id, first, f, f[len(f)].parts AS no, f[len(f)] AS b FROM fold WHERE j = len(p) + 1
  UNION ALL
  SELECT vendor_id, first, f, no - 1, f[b.pred + 1] FROM back WHERE no > 1
), segment AS (
  SELECT vendor_id, first, no, f[b.pred + 1].pos AS after, b.pos - b.pred AS n, b.s - f[b.pred + 1].s AS s, b.q - f[b.pred + 1].q AS q, f[len(f)].parts AS parts, f[len(f)].cost AS best FROM back
)
SELECT vendor_id, CAST(no AS INTEGER) AS segment_no, first + after AS first_day, n AS n_days, CAST(s AS BIGINT) AS total, CAST(v AS BIGINT) AS spread,
  CAST(n * floor(1000 * ln(CAST(v AS DOUBLE))) AS BIGINT) AS cost, parts AS n_segments, best AS best_cost
FROM (SELECT *, 1 + (n * q - s * s) // (n * n) AS v FROM segment)
"""
