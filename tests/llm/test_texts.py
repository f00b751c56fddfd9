"""The operators on texts against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, jaccard_join, language_id, packing, sharding, substring_dedup
from foliant.llm.hashing import spark_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, bucket int, size int"


def corpus():
    """Texts with near copies, a shared passage, exact copies and odd cases; columns whose names the operators use inside."""
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)] + ["Éa", "naïve", "日本語", "don't", "a\u00a0b", "x\u200by"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = say(70)
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A b  c\nd", "a b c d e", "!!! 123", "</s>", "\x1c\x1d ok"]
    base = say(120)
    for k in range(6):
        near = list(base)
        near[rng.randrange(120)] = "changed%d" % k
        texts.append(" ".join(near))
    far = list(base)
    far[10:60] = say(50)
    texts += [" ".join(far), " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(5):
        texts.append(" ".join(say(20 + k) + passage[k:] + say(15)))
    texts += [" ".join(passage[:49]), " ".join(passage[:50]), "  " + "\n".join(passage[10:65]), " ".join(say(3000)), "x" * 5000, " ".join(["same"] * 200), " ".join(["same"] * 90)]
    texts.append(" ".join(say(30) + passage[:25] + say(30)))
    return texts


def table(spark, texts, shuffled=True):
    rows = [(i, t, "en", "s", 1, "x", 1, 2) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_bpe_is_tiktoken(spark):
    texts = corpus() + ["\ud7ff\U0001f600 mixed \u0301 marks", "tabs\t\t\n\n  end  ", "ab" * 3000, "1234567 8", "it's we'll I'D"]
    df = table(spark, texts)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digest_texts(df, "doc_id").collect()}
    ids = bpe.encode_texts(df, "doc_id")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(ids, "doc_id").collect()}
    packed = {r.doc_id: bytes(r.ids) for r in ids.collect()}
    for i, t in enumerate(texts):
        want = np.array(lib.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert packed[i] == want and back[i] == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digest_texts(df.where("false"), "doc_id").count() == 0
    assert bpe.digest_texts(df.union(df), "doc_id").count() == 2 * len(texts)


def shingles(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks: clusters are cut and their pieces meet in pairs
    monkeypatch.setattr(jaccard_join, "ROW", block)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, texts), "doc_id").collect()}
    assert got == brute_components(texts)


def test_jaccard_of_different_texts_under_one_id(spark):
    """Against brute force over tables with repeated ids: rows are linked by their own text alone."""
    rng = random.Random(4)
    base = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    rows = []
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 12])):
            words[rng.randrange(40)] = f"n{k}{rng.randrange(9)}"
        rows.append((rng.randrange(20), " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(36)} for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted((rows[i][0], rows[i][1], min(rows[j][0] for j in range(60) if root[j] == root[i])) for i in range(60))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = jaccard_join.jaccard_components(df, "doc_id").join(df.select("doc_id", "text", substring_dedup.origin_of(F.col("text")).alias("origin")).distinct(), ["doc_id", "origin"])
    assert sorted((r.doc_id, r.text, r.component_id) for r in out.collect()) == want
    firsts = out.where("first").select("component_id", "doc_id", "text").distinct().collect()
    assert len(firsts) == len({root[i] for i in range(60)}) and all(r.doc_id == r.component_id for r in firsts)


def test_jaccard_odd_tables(spark):
    df = table(spark, corpus())
    assert jaccard_join.jaccard_components(df.where("false"), "doc_id").count() == 0
    assert jaccard_join.jaccard_components(df.where("text is null"), "doc_id").first().component_id == 0
    twice = jaccard_join.jaccard_components(df.union(df), "doc_id")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in twice.collect()} == {(k, *v) for k, v in brute_components(corpus()).items()} and twice.count() == 2 * df.count()


def test_signature_tree_misses_nothing():
    rng = np.random.default_rng(5)
    similar = jaccard_join.Similarity(75)
    base = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (5, 40, 300, 3000, 9000)]
    sets = []
    for b in base:
        for k in range(8):
            keep = b[rng.random(len(b)) > 0.04 * k]
            sets.append(np.unique(np.concatenate((keep, rng.integers(1, 2**63, k, dtype=np.uint64)))))
    maps, sizes = jaccard_join.signatures(sets), np.array([len(s) for s in sets])
    order = np.argsort(sizes)
    tree = jaccard_join.SignatureTree(maps[order], sizes[order])
    found = {tuple(sorted((int(order[a]), int(order[b])))) for x, y in tree.pairs(similar) for a, b in zip(x, y, strict=True)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert links and links <= found and len(found) < len(sets) * (len(sets) - 1) // 2


@pytest.mark.parametrize("across", [False, True])
def test_block_join_is_brute_force(across, monkeypatch):
    """All links come from the traversal; a large group of near copies needs few comparisons."""
    rng = np.random.default_rng(6)
    similar = jaccard_join.Similarity(75)
    sets = []
    for n in (5, 30, 200):
        for _ in range(12):
            b = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            sets += [np.unique(np.concatenate((b[rng.random(len(b)) > 0.08], rng.integers(1, 2**63, n // 20, dtype=np.uint64)))) for _ in range(6)]
    near = np.unique(rng.integers(1, 2**63, 150, dtype=np.uint64))
    sets += [np.delete(near, i % 150) for i in range(300)]
    sets = [s for s in sets if len(s)]
    side = rng.integers(0, 2, len(sets)) if across else np.zeros(len(sets), np.int64)
    compared = []
    monkeypatch.setattr(jaccard_join, "overlap", lambda a, b, f=jaccard_join.overlap: compared.append(1) or f(a, b))
    got = jaccard_join.join_block(sets, similar, side)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if (not across or side[i] != side[j]) and 100 * len(np.intersect1d(sets[i], sets[j], True)) >= 75 * len(np.union1d(sets[i], sets[j])):
                a, b = jaccard_join._find(root, i), jaccard_join._find(root, j)
                root[max(a, b)] = min(a, b)
    assert got.tolist() == [jaccard_join._find(root, i) for i in range(len(sets))]
    assert len(compared) < 12 * len(sets)


def brute_substrings(texts, window):
    words, first, out = [WORD.findall(t or "") for t in texts], {}, {}
    for i, w in enumerate(words):
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), i) < i:
                keep[p : p + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k))
    return out


@pytest.mark.parametrize("window", [50, 7, 2])
def test_substrings_are_brute_force(spark, window):
    texts = corpus()
    df = table(spark, texts)
    want = brute_substrings(texts, window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df, "doc_id", window=window, output="sha256").collect()}
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in want.items()}
    kept = {r.doc_id: r for r in substring_dedup.dedup_substrings(df, "doc_id", window=window).collect()}
    assert all(kept[i].kept == (k if m else (texts[i] or "")) for i, (n, m, k) in want.items())


def test_spark_hash(spark):
    x = [0, 1, -1, 64, 2**63 - 1, -(2**63), 123456789]
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v bigint").orderBy("i").select(F.xxhash64("v").alias("h")).collect()]
    assert got == spark_hash(np.array(x, np.int64)).tolist()


def test_substrings_with_hot_passage(spark, monkeypatch):
    """A passage in every document, ids that are multiples of 64, and buckets that are dealt over tasks."""
    rng = random.Random(5)
    say = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    passage = say(60)
    texts = [" ".join(say(rng.randrange(30)) + passage + say(rng.randrange(30))) for _ in range(150)] + corpus()
    df = table(spark, texts).withColumn("doc_id", F.col("doc_id") * 64)
    groups = substring_dedup._groups_of(np.arange(len(texts)) * 64, 64)
    assert len(set(groups.tolist())) > 40
    want = {64 * i: (n, m, k if m else (texts[i] or "")) for i, (n, m, k) in brute_substrings(texts, 50).items()}
    for limit in (substring_dedup.BUCKET_LIMIT, 300):
        monkeypatch.setattr(substring_dedup, "BUCKET_LIMIT", limit)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df, "doc_id").collect()} == want


def test_substrings_of_repeated_rows(spark):
    """Rows of one key are judged each alone against smaller keys."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, b), (2, a), (2, c), (2, "short"), (2, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("o", substring_dedup.origin_of(F.col("text")))
    texts = {(r.doc_id, r.o): r.text or "" for r in df.collect()}
    got = sorted((r.doc_id, texts[r.doc_id, r.origin][:5], r.n_removed) for r in substring_dedup.dedup_substrings(df, "doc_id").collect())
    assert got == [(1, a[:5], 0), (1, a[:5], 0), (1, b[:5], 0), (2, "", 0), (2, a[:5], 60), (2, c[:5], 0), (2, "short", 0)]


def test_substrings_odd_tables(spark):
    df = table(spark, corpus())
    assert substring_dedup.dedup_substrings(df.where("false"), "doc_id").count() == 0
    assert substring_dedup.dedup_substrings(df.where("text is null"), "doc_id").first().n_words == 0


def test_packing(spark):
    texts = corpus() + ["word " * 5000, "<|endoftext|> x", "e\u0301 \u03a3\u03a3 \u0130", "hello <|startoftext|> world<|endoftext|>, end", "<|startoftext|><|endoftext|>.", "A<|STARTOFTEXT|>b <|endoftext |>", "x" * 5000]
    df = table(spark, texts)
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.pack_documents(df, "doc_id").collect()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own, at = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    total = 0
    for s in {r.sequence_id for r in rows}:
        own, at = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset), 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += 1
    assert total <= 1 + -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(df.where("false"), "doc_id").count() == 0
    assert packing.pack_documents(df.union(df), "doc_id").count() == 2 * len(rows)


def test_bin_slack_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(5)}
        room = 100 - max(counts)
        sums = {0}
        for k, c in counts.items():
            c -= k == max(counts)
            sums = {s + k * i for s in sums for i in range(c + 1) if s + k * i <= room}
        got = packing.fill(counts, 100)
        assert sum(k * c for k, c in got.items()) == max(counts) + max(sums) and all(c <= counts[k] for k, c in got.items())
    rules, sequences = packing.plan({3: 1000, 5: 777, 2048: 4, 1024: 3})
    assert sum(len(r) for r in rules.values()) < 40 and sequences == 4 + 2 + -(-(3000 + 3885 - (2048 - 1024)) // 2048)


def test_language_id(spark):
    words = {"aa": "the of and that with for", "bb": "der die und das nicht ein", "cc": "les des une pour dans que"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(12)), k) for i in range(300) for k in ["aa", "bb", "cc"][i % 3 : i % 3 + 1]]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "der die und das nicht ein " * 4000, None), (None, "the of and that", "aa"), (1004, " ".join([words["aa"]] * 3 + [words["bb"]] * 9), "bb")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1)})
    out = language_id.identify(df).collect()
    got = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 40 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert got[1004].lang_pred == "bb" and 0.6 < got[1004].score < 0.9
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows) + len(odd)
    none = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.select("lang_pred").distinct().collect()} == {"und"}
    assert language_id.identify(df.where("false")).count() == 0


def test_language_sets_of_all_languages():
    words = ["the of and that with for", "der die und das nicht ein", "les des une pour dans que", "el los las por con una"]
    data = [np.frombuffer(w.encode(), np.uint8) for w in words]
    counts = np.stack([np.bincount(language_id._grams(np.tile(np.append(x, 32), 200)), minlength=language_id.BUCKETS) for x in data]) + 0.5
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    mixed = np.frombuffer(" ".join(w for i in range(200) for w in words).encode(), np.uint8)
    two = np.frombuffer(" ".join(w for i in range(200) for w in words[:2]).encode(), np.uint8)
    _, score = language_id.infer([(mixed, True), (two, True)], logs, 6, 5.0)
    assert 0.25 <= score[0] < 0.32 and 0.5 <= score[1] < 0.6


def test_sharding(spark):
    texts = corpus()
    df = table(spark, texts * 9).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("clash").alias("shard")).withColumn("c", F.crc32("text"))
    odd = df.union(df.where("doc_id < 3")).union(spark.createDataFrame([(None, "n", "z", 5), (None, "n", "z", 5)], df.schema))
    for shards in (1, 5, 24):
        out = sharding.shard_rows(odd, "doc_id", ["c"], shards=shards).collect()
        assert len(out) == odd.count()
        by = {}
        for r in out:
            by.setdefault(r.shard, []).append(r.slot)
        sizes = [len(by.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    clash = odd.select("*", *(F.lit(i).alias(n) for i, n in enumerate(("p_from", "p_shard", "_ring_slice", "slice", "place", "row", "rank", "slot", "a.b"))))
    same = sharding.shard_rows(clash, "doc_id", ["c"])
    assert same.columns[-2:] == ["shard", "slot"] and {(r.p_from, r.slice, r.row) for r in same.collect()} == {(0, 3, 5)}
    many = spark.range(20_000).withColumn("c", F.lit(1))
    for few, more in ((8, 9), (24, 25)):
        a, b = ({r.id: r.shard for r in sharding.shard_rows(many, "id", ["c"], shards=n).collect()} for n in (few, more))
        assert sum(a[k] != b[k] for k in a) < 2 / more * len(a)
    assert sharding.shard_rows(df.where("false"), "doc_id", ["c"]).count() == 0
    with pytest.raises(ValueError):
        sharding.ring(100, 64, 4096)


def test_sharding_query(spark, tmp_path):
    texts = corpus() + ["é" * 100, "same", "same"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op10_sharding(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(24)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
