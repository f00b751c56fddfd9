"""Upserts in place, listings by path and the kept hash index, with their files and plans."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.operators import dedup
from foliant.operators.kept_index import KeptIndex
from foliant.sources import artifacts


def files_of(root):
    return {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root).rglob("*.parquet")}


def test_upsert_rewrites_the_touched_folders_alone(spark, tmp_path):
    rows = {i: (f"text {i}", i * 1.5, None if i % 3 else "m") for i in range(200)}
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"), "id", 16)
    store.create(spark.createDataFrame([(k, *v) for k, v in rows.items()], "id bigint, text string, size double, mark string"))
    before = files_of(tmp_path / "store")
    changed = {5: ("new 5", None), 6: (None, 7.0), 900: ("added", 9.0)}
    n = store.upsert(spark.createDataFrame([(k, *v) for k, v in changed.items()], "id bigint, text string, size double"))
    after = files_of(tmp_path / "store")
    parts = {int(re.search(r"_part=(\d+)", str(p))[1]) for p in set(before) ^ set(after)}
    assert 1 <= n <= 3 and len(parts) == n
    untouched = [p for p in before if int(re.search(r"_part=(\d+)", str(p))[1]) not in parts]
    assert len(untouched) >= 13 and all(after[p] == before[p] for p in untouched)
    want = rows | {5: ("new 5", 7.5, rows[5][2]), 6: ("text 6", 7.0, "m"), 900: ("added", 9.0, None)}
    assert {r.id: (r.text, r["size"], r.mark) for r in store.read().collect()} == want
    assert store.upsert(spark.createDataFrame([], "id bigint, text string")) == 0 and files_of(tmp_path / "store") == after


def test_a_failed_upsert_leaves_the_old_rows(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"), "id", 4)
    store.create(spark.range(20).select("id", F.lit("old").alias("text")))
    before = files_of(tmp_path / "store")
    bad = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("no source"))).otherwise(F.lit("new")).alias("text"))
    for changes, kind in ((bad, Exception), (spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, text string"), ValueError), (spark.createDataFrame([(None, "a")], "id bigint, text string"), ValueError), (spark.createDataFrame([(1, "a")], "id bigint, other string"), ValueError)):
        with pytest.raises(kind):
            store.upsert(changes)
        assert files_of(tmp_path / "store") == before
    with pytest.raises(ValueError):
        artifacts.ArtifactStore(spark, str(tmp_path / "two"), "id").create(spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, text string"))
    with pytest.raises(Exception, match="(?i)exists"):
        store.create(spark.range(3).select("id", F.lit("x").alias("text")))
    assert files_of(tmp_path / "store") == before


def test_artifacts_by_path(spark, tmp_path):
    root = tmp_path / "ro ot" / "a+b"
    for name in ("x/1.txt", "x/deep/2.txt", "y/ü 3.txt", "y/other.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("abc")
    found = artifacts.listing(spark, str(root))
    assert {r.length for r in found.collect()} == {3}
    rows = spark.createDataFrame([(1, "x/1.txt"), (2, "x/deep/2.txt"), (3, "nope.txt"), (4, None)], "id int, place string")
    assert {r.id: r.artifact_length for r in artifacts.with_artifacts(rows, found, "place").collect()} == {1: 3, 2: 3, 3: None, 4: None}
    assert {r.id for r in artifacts.without_artifact(rows, found, "place").collect()} == {3, 4}
    assert artifacts.without_row(artifacts.listing(spark, str(root), "*.txt"), rows, "place").count() == 1
    assert artifacts.listing(spark, str(tmp_path / "absent")).count() == 0
    plan = artifacts.listing(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_the_kept_index_is_not_shuffled(spark, tmp_path):
    rng = random.Random(1)
    internal = [(i, f"text {rng.randrange(300)}") for i in range(500)] + [(900, None)]
    external = [(1000 + i, f"text {rng.randrange(600)}") for i in range(200)] + [(2000, None), (2001, "text 1"), (2002, "text 1")]
    frame = lambda rows: dedup.with_hash(spark.createDataFrame(rows, "id bigint, text string"), "text")
    index = KeptIndex(spark, "kept_index_test").build(frame(internal), "id", str(tmp_path / "index"), 4)
    own, sha = {t for _, t in internal if t}, lambda t: hashlib.sha256(t.encode()).hexdigest()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = index.exclude(frame(external))
        assert {r.id for r in out.collect()} == {i for i, t in external if t not in own}
        more = index.excluded(frame(external))
        got = {(r.id, r.matching_raw_paths) for r in more.collect()}
        assert got == {(i, " | ".join(str(k) for k, u in internal if u == t)) for i, t in external if t in own}
        near = {r.sha256 for r in index.near(frame(external)).collect()}
        assert {sha(t) for _, t in external if t in own} <= near and len(near) < len(own)
        assert index.exclude(frame(external).where("false")).count() == 0
        for df in (out, more):
            plan = df._jdf.queryExecution().executedPlan().toString()
            final = plan.split("== Initial Plan ==")[0]
            # each shuffle has the external rows or their filter below it: none lies above the index's scan
            assert "kept_index_test" in final and "Bucketed: true" in final
            lines = final.splitlines()
            depth = lambda s: len(s) - len(s.lstrip(" :+-*(0123456789)"))
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning" in line:
                    below = [x for x in lines[i + 1 :]]
                    end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
                    assert not any("kept_index_test" in x for x in below[:end]), line
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE kept_index_test")
