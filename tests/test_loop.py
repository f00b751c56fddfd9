"""The training loop against a single-process version."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from foliant.operators import loop, training

CLASSES = ["a", "b", "c"]


def corpus(n):
    rng = random.Random(3)
    words = {"a": "the cat sat on a mat".split(), "b": "le chat est sur la table".split(), "c": "der hund und die katze".split()}
    common = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        y = rng.choice(CLASSES)
        text = " ".join(rng.choice(words[y] if rng.random() < 0.3 else common) for _ in range(rng.randint(1, 25)))
        out.append((i, y, text, rng.choice(["train", "train", "train", "validation", "test"])))
    return [*out, (n, "a", None, "train"), (n + 1, "b", "", "validation"), (n + 2, "zz", "the cat", "train"), (None, "a", "x", "train"), (n + 3, "a", "The CAT " * 3000, "train")]


def single_process(rows, s):
    """The same loop without Spark, document by document."""
    data = []
    for key, y, text, part in rows:
        if key is None or y not in CLASSES:
            continue
        counts = {}
        for w in (text or "").lower().split():
            counts[zlib.crc32(w.encode()) % s.dim] = counts.get(zlib.crc32(w.encode()) % s.dim, 0) + 1
        long = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
        data.append((key, CLASSES.index(y), {k: math.log1p(c) / long for k, c in counts.items()}, part))
    train, judged = ([r for r in data if r[3] == p] for p in ("train", "validation"))
    w = np.zeros((len(CLASSES), s.dim + 1))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0

    def probabilities(x):
        scores = np.array([sum(w[c, k] * u for k, u in x.items()) + w[c, -1] for c in range(len(CLASSES))])
        e = np.exp(scores - scores.max())
        return e / e.sum()

    history, best, stale = [], -1.0, 0
    batches = -(-len(train) // s.batch)
    for epoch in range(1, s.epochs + 1):
        place = lambda r: int(hashlib.md5(f"{s.seed}:{epoch}:{r[0]}".encode()).hexdigest()[:12], 16) % batches  # noqa: B023, E731
        loss = hits = 0
        for start in range(0, batches, s.accumulation):
            total = np.zeros_like(w)
            for b in range(start, min(start + s.accumulation, batches)):
                own = [r for r in train if place(r) == b]
                for _, y, x, _ in own:
                    p = probabilities(x)
                    loss -= math.log(p[y])
                    hits += p.argmax() == y
                    p[y] -= 1
                    for k, u in [*x.items(), (s.dim, 1.0)]:
                        total[:, k] += p * u / len(own) / s.accumulation
            total *= min(1.0, s.norm / (math.sqrt((total**2).sum()) + 1e-6))
            t += 1
            m, v = 0.9 * m + 0.1 * total, 0.999 * v + 0.001 * total**2
            w = w * (1 - s.rate * s.decay) - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        table, vloss = np.zeros((len(CLASSES),) * 2), 0.0
        for _, y, x, _ in judged:
            p = probabilities(x)
            table[y, p.argmax()] += 1
            vloss -= math.log(p[y])
        f1 = [2 * table[c, c] / d if (d := table[c].sum() + table[:, c].sum()) else 0.0 for c in range(len(CLASSES))]
        history.append({"epoch": epoch, "train_loss": loss / len(train), "train_accuracy": hits / len(train), "validation_loss": vloss / len(judged), "validation_accuracy": np.trace(table) / len(judged), "validation_macro_f1": float(np.mean(f1))})
        if history[-1]["validation_macro_f1"] > best:
            best, stale, kept = history[-1]["validation_macro_f1"], 0, (epoch, w.copy())
        elif (stale := stale + 1) >= s.patience:
            break
    return history, kept


@pytest.mark.parametrize("settings", [loop.Settings(batch=16, accumulation=3, epochs=4, dim=256, rate=0.05), loop.Settings(batch=1000, accumulation=2, epochs=5, dim=64, rate=1.0, patience=1, norm=0.1, seed=7)])
def test_the_loop_is_the_single_process_one(spark, tmp_path, settings):
    rows = corpus(160)
    df = spark.createDataFrame(rows, "id bigint, label string, body string, part string").repartition(3)
    loop.features(df, "id", "label", "body", "part", CLASSES, settings.dim).write.parquet(str(tmp_path / "f"))
    table = spark.read.schema(loop.FEATURES).parquet(str(tmp_path / "f"))
    run = loop.train(table, CLASSES, settings, str(tmp_path / "run"))
    want, (epoch, weights) = single_process(rows, settings)
    assert len(run.history) == len(want)
    for got, row in zip(run.history, want, strict=True):
        assert all(abs(got[k] - row[k]) < 1e-6 for k in row), (got, row)
    assert run.best_epoch == epoch
    found, about = loop.load_weights(spark, run.best, CLASSES)
    assert np.abs(found - weights).max() < 1e-6 and about["epoch"] == epoch
    history = run.table(spark)
    assert [r.epoch for r in training.best_epochs(history).where("improved").orderBy("epoch").collect()][-1] == epoch
    assert training.early_stop(history, patience=settings.patience).count() == len(want)
    with pytest.raises(ValueError):
        loop.load_weights(spark, run.best, CLASSES[::-1])
    scores = {r.document: r.scores for r in loop.predict(table, found).collect()}
    assert len(scores) == sum(r[0] is not None and r[1] in CLASSES for r in rows) and all(abs(sum(map(math.exp, s)) - 1) < 1e-9 for s in scores.values())


def test_packed_rows_are_the_feature_rows(spark):
    """Bytes give the same measures and sums as lists; before, there were lists alone."""
    df = spark.createDataFrame(corpus(50), "id bigint, label string, body string, part string").repartition(3)
    rows = loop.features(df, "id", "label", "body", "part", CLASSES, 64).cache()
    weights = np.random.default_rng(1).normal(size=(3, 65))
    one, two = loop.evaluate(rows, weights), loop.evaluate(loop.packed(rows), weights)
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)
    own = loop.batch_of(loop.Settings(), 1, 3).alias("batch")
    a, b = (loop.step_sums(t.select("*", own), weights) for t in (rows, loop.packed(rows)))
    assert set(a) == set(b) and all(np.abs(a[k][0] - b[k][0]).max() < 1e-9 and a[k][3] == b[k][3] for k in a)
    assert loop.packed(rows.where("false")).count() == 0 and [r.y for r in loop.packed(rows.where("document = 50")).collect()] == [0]


def test_clipping_and_empty_tables(spark):
    g = np.array([[3.0, 4.0]])
    assert np.allclose(loop.clipped(g, 1.0), g / 5, atol=1e-6) and (loop.clipped(g, 10.0) == g).all()
    none = spark.createDataFrame([], loop.FEATURES)
    with pytest.raises(ValueError):
        loop.train(none, CLASSES)
    assert loop.evaluate(none, np.zeros((3, 5))) == {"loss": 0.0, "accuracy": 0.0, "macro_precision": 0.0, "macro_recall": 0.0, "macro_f1": 0.0}
