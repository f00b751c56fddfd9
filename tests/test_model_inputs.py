"""Subword tokens against the library on whole texts, batches, and providers that take batches."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from foliant.functions import subwords
from foliant.operators import scoring

PATH = public_tokenizers.path("piece_bpe_32k.model")
CLASSES = ["a", "b"]


@pytest.mark.parametrize("longest", [None, 512, 20])
def test_tokens_are_the_library_s(spark, longest):
    rng = random.Random(6)
    parts = ["the", "Katze", "été", "ñ", "don't", "x" * 30, "12345", "▁", "<s>", "</s>", "日本語", "é", "​", "ﬁ", "①", "😀", "a​b", "½", "A.B,C", "­"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["", None, "  white \t space\n\n here ", "word " * 5000, "solo"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"tokens": F.lit(1), "dotted.name": F.lit(2)}).repartition(3)
    out = subwords.subword_tokens(df, PATH, longest=longest)
    assert out.columns == ["id", "text", "dotted.name", "tokens"]
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in out.collect():
        whole = lib.encode(" ".join((texts[r.id] or "").split()))
        want = [1, *(whole if longest is None else whole[: longest - 2]), 2]
        assert r.tokens == want, texts[r.id]
    assert subwords.subword_tokens(df.where("false"), PATH).count() == 0


def test_padding():
    ids, mask = subwords.padded([np.array([5, 6, 7]), np.array([8]), np.array([], int)], 0)
    assert ids.tolist() == [[5, 6, 7], [8, 0, 0], [0, 0, 0]] and mask.tolist() == [[1, 1, 1], [1, 0, 0], [0, 0, 0]]
    rows = ["aa", "", "aaaa", "a", "aaa"]
    assert list(subwords.by_length(rows, len, 2)) == [[2, 4], [0, 3], [1]]


def test_a_failed_batch_is_halved(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def score(rows):
            with open(calls, "a") as f:
                f.write(f"{len(rows)}\n")
            if any(len(r) % 10 == 3 for r in rows):
                raise RuntimeError("bad length")
            return [[float(len(r)), 0.0] for r in rows]

        return score

    df = spark.range(40).select("id", F.lit("a").alias("label"), F.expr("repeat('x', cast(id as int))").alias("text")).coalesce(1)
    scored, found = scoring.recorded(scoring.score_provider(df, scoring.Provider("m", load, 8), "id", "label", "text", CLASSES), str(tmp_path / "records"))
    out = {r.document: r for r in scored.collect()}
    assert {k for k, r in out.items() if r.status == "failed"} == {3, 13, 23, 33} and out[3].error_message == "RuntimeError: bad length"
    assert all(r.predicted_label == "a" and r.prediction_time_seconds >= 0 for k, r in out.items() if r.status == "success")
    sizes = [int(x) for x in open(calls).read().split()]
    assert sizes.count(8) == 5 and len(sizes) < 40
    assert (found["documents"], found["processed"], found["failed"]) == (40, 36, 4) and abs(found["seconds"] - sum(r.prediction_time_seconds or 0 for r in out.values())) < 1e-9


def test_wrong_answers_fail_their_rows(spark):
    df = spark.range(4).select("id", F.lit("a").alias("label"), F.col("id").alias("x"))

    def short():
        return lambda rows: [[1.0, 0.0]] * (len(rows) - 1)

    def narrow():
        return lambda rows: [[1.0, 0.0] if r != 2 else [1.0] for r in rows]

    assert {r.error_message for r in scoring.score_provider(df, scoring.Provider("s", short, 4), "id", "label", "x", CLASSES).collect()} == {"ValueError: 0 answers for 1 inputs"}
    assert {r.document for r in scoring.score_provider(df, scoring.Provider("n", narrow, 4), "id", "label", "x", CLASSES).where("status = 'failed'").collect()} == {2}
    assert scoring.score_provider(df.where("false"), scoring.Provider("n", narrow, 4), "id", "label", "x", CLASSES).count() == 0
