"""Personal data, change points and centroid clustering against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import centroids, change_points, personal_data

# --- personal data ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PLAIN.items()}


def test_base_spans_are_the_plain_ones():
    rng = random.Random(5)
    parts = ["a@b.c", "@", "x.y", "_", "+", "1", "12", "255", "256", ".", "-", " ", "  ", "(", ")", "a-b", "%", "é", "\n", "4111 1111 1111 1111", "4111-1111-1111-1112", "00001", "+1 (017) 555-7713", "1.2.3.4", "user@mail.example.com", "d@e", "٣", "²", "😀"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_long_texts_take_time_with_their_length():
    text = "a" * 300_000 + "@" * 1000 + "1" * 300_000 + " " + "1 " * 100_000 + "+1" + " " * 100_000
    spans = personal_data.base_spans(text)
    assert not any(spans.values())
    for odd in ("a" * 200_000, "1" * 200_000, "12-" * 60_000, "a:" * 100_000, "(1" * 100_000, "a at b dot " * 10_000):
        list(personal_data.candidates(odd, personal_data.base_spans(odd)))


def people(n):
    rng = random.Random(7)
    out = []
    for i in range(n):
        luhn = "411111111111111" + str(rng.randint(0, 9))
        text = f"word {i} call +1 (201) 555-{rng.randint(1000, 9999)} or mail u{i}@mail.example.com; card {luhn} from 10.0.{i % 256}.7 é"
        out.append((i, text))
    return out


HIDDEN = [
    (9000, "please call (555) 234-5678 tomorrow", "(555) 234-5678"),
    (9001, "write to john (at) example (dot) com now", "john (at) example (dot) com"),
    (9002, "server 2001:db8:0:0:0:ff00:42:8329 is up", "2001:db8:0:0:0:ff00:42:8329"),
    (9003, "her card 4111.1111.1111.1111 was used", "4111.1111.1111.1111"),
    (9004, "ring +1 (843) 555-7672 170.106.47.218 now", "+1 (843) 555-7672"),
]
CLEAN = ["on 2024-01-05 it rained", "the sum of 12 345 678 was paid", "version 10.2.3 of it", "number 1234567890123456 fails", "look at the house. Then dot it", "at 10:20:30 they left", "", None, "plain words only"]


def test_personal_data(spark):
    rows = people(300) + [(k, t) for k, t, _ in HIDDEN] + [(9100 + i, t) for i, t in enumerate(CLEAN)] + [(None, "x@y.zz"), (5, "x@y.zz"), (5, "x@y.zz"), (9200, "w " * 50_000 + "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"base_spans": F.lit("clash"), "kind": F.lit(1)}).repartition(3)
    model = personal_data.train(df)
    out = personal_data.digests(personal_data.detect(df, model))
    assert out.columns[:3] == ["doc_id", "text", "kind"]
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans").collect()), key=str)
    assert len(got) == len(rows)
    for key, text, *counts, more, digest, spans in got:
        want = plain_spans(text or "")
        base = [f"{k}:{a}:{b}" for k in PLAIN for a, b in want[k]]
        assert counts == [len(want[k]) for k in PLAIN] and digest == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = [s for s in spans.split(",") if s]
        assert set(base) <= set(every) and len(every) == len(base) + more
        assert every == sorted(every, key=lambda s: (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])))
        if key is not None and key >= 9100:
            assert more == 0, text
        for k, t, hidden in HIDDEN:
            if k == key:
                assert f"{t.index(hidden)}:{t.index(hidden) + len(hidden)}" in spans, (t, spans)


def test_personal_data_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    model = personal_data.train(none)
    assert personal_data.digests(personal_data.detect(none, model)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert tuple(personal_data.digests(personal_data.detect(null, model)).select("n_email", "n_added", "spans", "base_sha256").first()) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_reliabilities_find_the_good_labelers():
    """Votes drawn from labelers of given reliability: the estimates come near, without any known truth."""
    rng = np.random.default_rng(2)
    right = np.array([0.95, 0.9, 0.75, 0.6, 0.85, 0.9])
    truth = rng.random(20_000) < 0.4
    correct = rng.random((len(truth), len(right))) < right
    says = np.where(correct == truth[:, None], 1, -1) * (rng.random(correct.shape) < 0.7)
    patterns, counts = np.unique(((says + 1) * 3 ** np.arange(len(right))).sum(axis=1), return_counts=True)
    found, share = personal_data.reliabilities(patterns, counts.astype(float), np.full(len(patterns), -1))
    assert np.abs(found - right).max() < 0.03 and abs(share - 0.4) < 0.03


def test_the_classifier_corrects_the_votes():
    rows = [([1, 2], 0.0, 1.0), ([1, 3], 0.0, 0.0)] * 200
    w = personal_data.fit(rows)
    assert w[2] > 1 and w[3] < -1 and abs(w[1]) < 0.3
    assert not personal_data.fit([]).any()


def test_redact():
    text = "mail a@b.cc or +1 (201) 555-1234 now"
    spans = [(personal_data.KINDS.index(k), a, b) for k, own in personal_data.base_spans(text).items() for a, b in own]
    assert personal_data.redact(text, spans) == "mail [email] or [phone] now"


# --- change points ---


def segment_cost(x):
    n, s, q = len(x), sum(x), sum(v * v for v in x)
    v = 1 + (n * q - s * s) // (n * n)
    return n * math.floor(1000 * math.log(v)), v


def all_cuts(n, least):
    """Every way to cut n days, by trying them all."""
    out = [()] if n >= least else []
    for k in range(1, n // least):
        out += [c for c in itertools.combinations(range(least, n - least + 1), k) if all(b - a >= least for a, b in zip((0, *c), (*c, n), strict=True))]
    return out or [()]


def brute(x, least, penalty):
    def value(cuts):
        edges = (0, *cuts, len(x))
        return sum(segment_cost(x[a:b])[0] for a, b in zip(edges, edges[1:], strict=False)) + penalty * len(cuts)

    return min(all_cuts(len(x), least), key=lambda c: (value(c), len(c), tuple(reversed(c)))), value


@pytest.mark.parametrize("factor", [1, 10**7])
def test_change_points_are_the_best_of_all(spark, factor):
    """Against all ways to cut; the large factor needs decimals. Constant series tie everywhere."""
    rng = random.Random(11)
    series = {k: [factor * rng.choice([0, 1, 2, 5]) * (20 if (d // 6) % 2 and k % 3 else 1) for d in range(rng.randint(1, 16))] for k in range(40)}
    series |= {100: [0] * 15, 101: [factor * 3] * 14, 102: [factor], None: [1, 2, 3], 103: [-factor, factor] * 7}
    rows = [(k, 19_000 + (k or 0) + d, v) for k, x in series.items() for d, v in enumerate(x) if v or d in (0, len(x) - 1)]
    daily = spark.createDataFrame(rows, "key bigint, day int, x bigint").repartition(3)
    least, penalty = 3, 2000
    got = {}
    for r in change_points.change_points(daily, least, penalty).collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == set(series)
    for k, x in series.items():
        cuts, value = brute(x, least, penalty)
        edges = (0, *cuts, len(x))
        want = [(i + 1, 19_000 + (k or 0) + a, b - a, sum(x[a:b]), segment_cost(x[a:b])[1], segment_cost(x[a:b])[0], len(cuts) + 1, value(cuts)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert sorted(tuple(r)[1:] for r in got[k]) == want, (k, x)


def test_daily_totals(spark):
    rows = [(1, "2024-01-01 23:59:59", 5), (1, "2024-01-01 00:00:00", 5), (1, "2024-01-03 10:00:00", 2), (None, "2024-01-01 10:00:00", 1), (2, None, 7), (2, "2024-01-01 10:00:00", None), (1, "2024-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "v bigint, at string, q int").withColumns({"day": F.lit("clash"), "key": F.lit("clash"), "x": F.lit(1)})
    got = change_points.daily_totals(df, F.col("v"), F.col("at").cast("timestamp_ntz"), F.col("q"))
    assert {tuple(r) for r in got.collect()} == {(1, 19723, 15), (1, 19725, 2), (None, 19723, 1)}
    assert change_points.change_points(got.where("false")).count() == 0
    first = change_points.change_points(got).where("key = 1").first()
    assert (first.n_days, first.total, first.n_segments) == (3, 17, 1)


# --- centroid clustering ---


def lloyd(rows, k, rounds, scale):
    """In plain Python; rows: (id, vector, seed)."""
    q = [(i, [math.floor(float(c) * scale) for c in v], s) for i, v, s in rows]
    z = [v for _, v, s in sorted((r for r in q if r[2] is not None), key=lambda r: (r[2], r[1]))][:k]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(z)), key=lambda j: (far(v, z[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v, _ in q]
        z = [[sum(c) // n for c in zip(*(v for (_, v, _), o in zip(q, own, strict=True) if o == j), strict=True)] if (n := own.count(j)) else z[j] for j in range(len(z))]
    return sorted(((i, near(v), far(v, z[near(v)])) for i, v, _ in q), key=str), z


@pytest.mark.parametrize("kind, scale, block", [("groups", 16, 64), ("random", 4, 2048), ("copies", 8, 32), ("large", 2**24, 64)])
def test_clusters_are_plain_lloyd(spark, monkeypatch, kind, scale, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((260, 6))
    if kind == "groups":
        x = x * 0.05 + rng.standard_normal((4, 6))[rng.integers(0, 4, 260)] * 3
    if kind == "copies":
        x[80:] = x[3]
    x = np.round(x, 2)
    rows = [(None if i == 7 else i % 250, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0] * 5), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6), (905, [])]
    df = spark.createDataFrame(rows + odd, "id bigint, v array<double>").withColumns({"cluster": F.lit("clash"), "distance": F.lit(0), "seed": F.lit(9)}).repartition(3)
    seed = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    found = centroids.cluster(df, "id", "v", seed, 5, 4, scale, 6)
    mark = lambda i: None if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    want, z = lloyd([(i, v, mark(i)) for i, v in rows], 5, 4, scale)
    assert found.centroids == z
    assert sorted((tuple(r) for r in found.rows.collect()), key=str) == want
    if kind in ("groups", "copies"):
        assert found.whole[-1] >= 60  # of 260, in blocks of 64 or 32
    for r in centroids.with_inertia(found).collect():
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, z[r.cluster])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id bigint, v array<float>")
    found = centroids.cluster(df, "id", "v", F.col("id"), 8, 3, 10, 2)
    assert sorted(map(tuple, found.rows.collect())) == [(1, 0, 0), (2, 1, 0)] and len(found.centroids) == 2
    none = centroids.cluster(df.where("false"), "id", "v", F.col("id"), 8, 3, 10, 2)
    assert centroids.with_inertia(none).count() == 0 and none.centroids == []
    with pytest.raises(Exception, match="leave a long"):
        centroids.cluster(df.withColumn("v", F.expr("transform(v, c -> c * 1e30D)")), "id", "v", F.col("id"), 8, 3, 10, 2)


def test_ball_tree_holds_its_promises():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (700, 5))
    x[300:600] = x[0]
    tree, order = centroids.BallTree.grow(x)
    assert sorted(order.tolist()) == list(range(700)) and (tree.vectors == x[order]).all()
    for (a, b, left, right), s, r in zip(tree.nodes.tolist(), tree.sums, tree.radius, strict=True):
        own = tree.vectors[a:b]
        assert (own.sum(axis=0) == s).all() and np.sqrt(((own - s / (b - a)) ** 2).sum(axis=1)).max() <= r + 1e-9
        if left >= 0:
            assert tree.nodes[left, :2].tolist() + tree.nodes[right, :2].tolist() in ([a, a + (b - a) // 2, a + (b - a) // 2, b], [a + (b - a) // 2, b, a, a + (b - a) // 2])
    z = rng.integers(-500, 500, (6, 5))
    node, who, rest = tree.filter(z)
    near = centroids.exact_distances(tree.vectors, z, True).argmin(axis=1)
    covered = list(rest)
    for k, c in zip(node.tolist(), who.tolist(), strict=True):
        a, b = tree.nodes[k, :2]
        assert (near[a:b] == c).all()
        covered += range(a, b)
    assert sorted(covered) == list(range(700))
