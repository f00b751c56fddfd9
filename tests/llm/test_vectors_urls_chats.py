"""Top-k search, near vectors, URL filter and chat formatting against brute force and round trips."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat_format, near_vectors, topk, url_filter

ODD = [(9000, None), (9001, [None] * 16), (9002, [float("nan")] * 16), (9003, [float("inf")] + [0.0] * 15), (9004, [0.0] * 16), (9005, [1.0, 2.0]), (9006, []), (None, [1.0] * 16)]


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"x": F.lit(1), "id": F.lit("clash"), "label": F.lit(0)}).repartition(3)


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_top_k_is_brute_force(spark, lists):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[200:260] = x[0]  # ties
    df = vectors(spark, x, ODD)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df.union(df), F.pmod("vec_id", F.lit(50)) == 0, "vec_id", "embedding", lists=lists).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    full = {i: q[i] for i in range(300)} | {9004: np.zeros(16, np.int64)}
    want = {}
    for i in [k for k in full if k % 50 == 0]:
        best = sorted(((int(-(full[i] @ full[j])), j) for j in full if j != i))[:5]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert {k: v for k, v in got.items() if k[0] < 9000} == want


def test_top_k_small_tables(spark, monkeypatch):
    df = vectors(spark, np.eye(3, 16))
    assert topk.search(df, F.col("vec_id") == 0, "vec_id", "embedding").count() == 2
    assert topk.search(df.where("false"), F.col("vec_id") == 0, "vec_id", "embedding").count() == 0
    assert topk.search(df, F.lit(False), "vec_id", "embedding").count() == 0
    big = spark.createDataFrame([(0, [2.0**21] * 3), (1, [2.0**21 + 1] * 3)], "vec_id bigint, embedding array<double>")
    assert topk.search(big, F.col("vec_id") == 0, "vec_id", "embedding").first().score == 3 * (256 * 2**21) * (256 * (2**21 + 1))
    with pytest.raises(ValueError):
        topk.search(big.withColumn("embedding", F.transform("embedding", lambda x: x * 4096)), F.col("vec_id") == 0, "vec_id", "embedding")


def test_top_k_phases(spark, monkeypatch):
    """Blocks of queries, negative scores, a group of equal vectors; and few entries are sent and resolved."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:1100] = x[3]
    x[5] = -10
    x[1200:1300] = np.abs(x[1200:1300])
    df = vectors(spark, x)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    full = q @ q.T
    for values in (topk.BLOCK_VALUES, 100):
        monkeypatch.setattr(topk, "BLOCK_VALUES", values)
        meter = [spark.sparkContext.accumulator(0) for _ in range(3)]
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.pmod("vec_id", F.lit(100)) == 5, "vec_id", "embedding", meter=meter).collect()}
        asked = [i for i in range(1500) if i % 100 == 5]
        assert got == {(i, n + 1): (j, -s) for i in asked for n, (s, j) in enumerate(sorted((-int(full[i, j]), j) for j in range(1500) if j != i)[:5])}
        entries, sent, resolved = (m.value for m in meter)
        assert entries == 2 * len(asked) * (1500 - 401 + 6) and 0 < resolved <= sent < 0.1 * entries


def planted(n, dim, low, rng):
    """Unit vectors, of which every third has a partner at a cosine between low and 1."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n - 1, 3):
        c = rng.uniform(low, 1)
        d = rng.standard_normal(dim)
        d -= (d @ x[i]) * x[i]
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * d / np.linalg.norm(d)
    return x


def test_lattice_decoding():
    rng = np.random.default_rng(1)
    short = near_vectors.minimal_vectors()
    assert len(short) == 240 and np.allclose((short**2).sum(axis=1), 2)
    x = rng.standard_normal((500, 8)) * 2
    p = near_vectors.decode_e8(x)
    assert ((np.allclose(p * 2, np.rint(p * 2))) and (np.rint(p.sum(axis=1)) % 2 == 0).all())
    gap = ((x - p) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all() and all((gap <= ((x - (p + s)) ** 2).sum(axis=1) + 1e-9).all() for s in short)


@pytest.mark.parametrize("cell", [2048, 5])
def test_near_vectors_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(near_vectors, "CELL_ROWS", cell)  # small cells are cut into blocks that meet in pairs
    rng = np.random.default_rng(4)
    x = planted(600, 16, 0.9, rng)
    x[:40] = x[0] + rng.standard_normal((40, 16)) * 0.01
    df = vectors(spark, x, ODD)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df.union(df), "vec_id", "embedding").collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = y @ y.T >= 0.9
    np.fill_diagonal(close, False)
    true, found = close.sum(axis=1), np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum() and (found[:40] >= 39).all()
    assert all(got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(40))
    assert all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006)) and len(got) == 607
    assert near_vectors.near_duplicates(df.where("false"), "vec_id", "embedding").count() == 0


def near_pairs(dim, low, high, n, seed):
    """Unit vectors a and b of which each pair has a cosine between low and high."""
    rng = np.random.default_rng(seed)
    a, d = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d -= (a * d).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * d


@pytest.mark.parametrize("rows", [1000, 51_282, 300_000, 2_000_000, 77_000_000])
def test_near_vectors_recall_at_every_size(rows):
    """Cells get finer with the rows and tables more, so that the pairs next to the limit are found alike."""
    settings = near_vectors.settings_for(rows)
    a, b = near_pairs(64, 0.9, 0.91, 800, 8)
    ka, kb = (near_vectors.cell_keys(x, *settings) for x in (a, b))
    met = (ka == kb[:, :, :1]).any(axis=(1, 2)) | (kb == ka[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.97


def test_keys_and_sketches():
    a, b = near_pairs(64, 0.9, 0.9, 3000, 3)
    settings = near_vectors.settings_for(51_282)
    one = np.concatenate([near_vectors.cell_keys(a[i : i + 1], *settings) for i in range(50)])
    assert (one == near_vectors.cell_keys(a, *settings)[:50]).all()
    assert (near_vectors.cell_keys(a[:9], range(2, 4), *settings[1:]) == near_vectors.cell_keys(a[:9], *settings)[:, 2:4]).all()
    differ = np.bitwise_count((near_vectors.sketches(a) ^ near_vectors.sketches(b)).view(np.uint64)).sum(axis=1)
    assert differ.max() <= near_vectors.most_bits(0.9) < 48
    for lattices, scale, found, _ in near_vectors.CELLS[:3]:
        ka, kb = (near_vectors.cell_keys(x, 1, 4, scale, lattices) for x in (a, b))
        assert ((ka == kb[:, :, :1]).any(axis=(1, 2)) | (kb == ka[:, :, :1]).any(axis=(1, 2))).mean() > found - 0.03


def test_near_vectors_in_64_dimensions(spark, monkeypatch):
    """Brute force over random vectors, pairs next to the limit and a close group; in rounds of one table."""
    monkeypatch.setattr(near_vectors, "ROUND_ROWS", 0)
    monkeypatch.setattr(near_vectors, "ROUND_KEYS", 5)
    rng = np.random.default_rng(2)
    a, b = near_pairs(64, 0.9, 0.91, 300, 4)
    close = a[0] + rng.standard_normal((60, 64)) * 0.02
    x = np.concatenate((a, b, close, rng.standard_normal((300, 64)))).astype(np.float32)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(vectors(spark, x), "vec_id", "embedding").collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = (y @ y.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found[600:660].min() >= 59
    plain = np.r_[1:300, 301:600]
    assert found[plain].sum() >= 0.9 * true[plain].sum() > 500


def test_url_rules(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://EXAMPLE.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/2": ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/2": ("x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "https://example.com/EN/2": ("example.com", "/EN/2", "com/", "allow"),
        "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/fr": ("b.net", "/fr", None, None),
        "http://notcom/": ("notcom", "/", None, None),
        "http://com": ("com", "", None, None),
        "x://y?z": ("y", "", None, None),
        "no scheme.com/": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://a.org/" + "x" * 20000: ("a.org", "/" + "x" * 20000, None, None),
        "http://\nq.org/a\nb": ("\nq.org", "/a\nb", None, None),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df.union(df)).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
        assert (r.p_block is None) == (rule is not None)
    assert url_filter.filter_urls(df.where("false")).count() == 0


def brute_probability(host, path, w):
    """The same probability by loops over one url."""
    low, score = 2**64 - 1, w[-1]
    for part, text in (("host", host), ("path", path)):
        length, salt = url_filter.PARTS[part]
        b = b"^" + bytes(48 if 48 <= c <= 57 else c for c in text.encode()) + b"$"
        buckets = set()
        for n in url_filter.SIZES:
            for i in range(len(b) - n + 1):
                h = salt
                for c in b[i : i + n]:
                    h = (h * 0x100000001B3 + c) & low
                h = (h + n - 1) & low
                h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & low
                h = ((h ^ h >> 27) * 0x94D049BB133111EB) & low
                buckets.add((h ^ h >> 31) % (len(w) - 1))
        score += sum(w[x] for x in buckets) * length / math.sqrt(len(buckets)) if buckets else 0
    return 1 / (1 + math.exp(-score))


def brute_url(url):
    """(host, path, verdict and rule or None) by string functions."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(r), v, r) for v, r in url_filter.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit)[1:] if fit else None


def test_url_filter_is_brute_force(spark):
    rng = random.Random(11)
    piece = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
    urls = [None, "", "://", "http://", "no/scheme", "http://é.org/ü?x", "x://" + "a" * 3000 + "/" + "b/" * 3000]
    urls += [rng.choice(["http://", "HTTPS://", "://", ""]) + piece(["www.", "example.", "Example.", "com", "net", "casino", "org", "1", "é", "-"]) + rng.choice(["", "/", "/en/", "/es/", "/fr/", "?", "#"]) + piece(["en/", "/", "x", "7", "?", "#", "com/", "\n", " "]) for _ in range(400)]
    urls += urls[:50]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("clash"), "p_block": F.lit("clash"), "_rule": F.lit(3), "bucket": F.lit(4)}).repartition(3)
    w = url_filter.train(url_filter.default_table())
    rows = url_filter.filter_urls(df).collect()
    assert len(rows) == len(urls) and all(r._rule == 3 and r.bucket == 4 for r in rows)
    for r in rows:
        host, path, rule = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        if rule:
            assert r.verdict == rule[0] and r.p_block is None
        else:
            want = brute_probability(host, path, w)
            assert abs(r.p_block - want) < 1e-9 and r.verdict == ("block" if want >= url_filter.THRESHOLD else "allow")


HELD_BAD = """goldencasino.net/spin grand-casinos.org/poker/table superbets.com/bookie bet-bonus.info/signup slimming-pills.org/order
online-pharmacy.net/viagra-cheap adultfilms.com/watch porn-hd.info/videos live-sexcam.org/chat quick-loan.net/apply
crypto-giveaway.com/send replica-bags.org/buy crackedsoft.net/keygen/serial torrents.info/movie/download popup-ads.org/click
ad-tracker.net/redirect spam-links.com/buy backlink-farm.org/seo free-giveaway.info/claim/prize account-verify-login.net/password""".split()
HELD_GOOD = """www.maritime-history.org/ships/schooners townhall.net/meetings/minutes cathedral.com/organ/recitals
docs.database.info/queries/joins linguistics.university.org/phonology gardening.net/roses/pruning mountainrescue.com/training/avalanche
eveningnews.info/sport/cricket railmuseum.org/locomotives village-school.net/timetable wildflowers.com/meadow/poppies
help.spreadsheet.info/formulas/sum farmhouse.org/cheese theweatherstation.net/rainfall symphony.com/programme law-library.info/statutes
tennis-club.org/courts/booking stones.net/granite/quarry translation.com/grammar/verbs nursing.info/careers
questions.net/11227809/sorted-array source.org/editor/commits win-help.org/desktop/icons paper.com/2021/05/01/world/summit.html""".split()


def test_url_model_on_held_out_urls():
    labelled = url_filter.default_table()
    w = url_filter.train(labelled)

    def blocked(urls):
        hosts, paths = zip(*map(url_filter.cut_url, urls), strict=True)
        return url_filter.probabilities(pa.array(hosts), pa.array(paths), w) >= url_filter.THRESHOLD

    known = {host for host, _, _ in labelled}
    assert not known & {url_filter.cut_url(u)[0] for u in HELD_BAD + HELD_GOOD}
    caught, wrong = blocked(HELD_BAD).sum(), blocked(HELD_GOOD).sum()
    assert caught >= 0.9 * len(HELD_BAD) and caught >= 0.9 * (caught + wrong)
    assert (blocked([h + p for h, p, _ in labelled]) == [bool(y) for _, _, y in labelled]).all()
    assert not url_filter.train([]).any()


def test_url_table_shares_nothing_with_the_test_tables():
    tables = sorted(Path("/root/testdata").glob("*/pages.parquet"))
    own = url_filter.default_table()
    common = {"www", "blog", "org", "net", "com", "info", ""}
    labels, paths = {x for h, _, _ in own for x in h.split(".")} - common, {p for _, p, _ in own if p}
    for t in tables:
        for url in pq.read_table(t, columns=["url"])["url"].to_pylist():
            host, path, _ = brute_url(url)
            assert not labels & set(host.split(".")) and path not in paths


def chats(spark):
    schema = """id int, prompt string, response string, completion string, system string, instruction string, input string, output string, question string, answer string,
    messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, turns array<struct<speaker:string,text:string>>, lang string"""
    rows = [
        {"id": 1, "prompt": "p", "response": "r", "lang": "en"},
        {"id": 2, "prompt": "p", "completion": "r"},
        {"id": 3, "system": "s", "prompt": "p", "response": "r"},
        {"id": 4, "instruction": "do", "input": "", "output": "done"},
        {"id": 5, "instruction": "do", "input": "this", "output": "done"},
        {"id": 6, "instruction": "do", "output": "done"},
        {"id": 7, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}, {"role": None, "content": "c"}]},
        {"id": 8, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"id": 9, "turns": [{"speaker": "bot", "text": "</s>[INST] \\ < [/INST]\n"}]},
        {"id": 10, "prompt": "p", "answer": "odd layout"},
        {"id": 11, "messages": []},
        {"id": 12, "question": "q", "answer": "a"},
        {"id": 13},
    ]
    import json

    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def test_layouts(spark):
    done = {r.id: r for r in chat_format.format_conversations(chats(spark)).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    turns = lambda i: [(t.role, t.text) for t in done[i].turns]
    assert turns(1) == turns(2) == [("user", "p"), ("assistant", "r")] and done[2].layout == "prompt_completion"
    assert turns(3) == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert turns(4) == [("user", "do"), ("assistant", "done")] == turns(6) and turns(5)[0] == ("user", "do\nthis")
    assert turns(7) == [("user", "a"), ("assistant", ""), ("", "c")] and turns(8) == [("user", "a"), ("assistant", "b")]
    assert turns(9) == [("assistant", "</s>[INST] \\ < [/INST]\n")] and turns(12) == [("user", "q"), ("assistant", "a")]
    assert done[10].layout is None and done[10].formatted is None and done[13].turns is None
    assert turns(11) == [] and done[11].formatted == "" and done[11].loss == []
    for i, r in done.items():
        if r.turns is not None:
            assert [(t.role, t.text) for t in r.back] == turns(i)
            assert r.formatted.count("</s>") == r.formatted.count("[INST]") == r.formatted.count("[/INST]") == len(r.turns)
            assert len(r.loss) == sum(t.role == "assistant" for t in r.turns)
    marks = {m.fingerprint for m in chat_format.MAPPINGS}
    assert len(marks) == len(chat_format.MAPPINGS)
    with_clash = chats(spark).where("id = 1").withColumns({"layout": F.lit("x"), "extra": F.lit(2)})
    assert chat_format.canonical_turns(with_clash).first().layout == "prompt_response"


def test_turn_rows(spark):
    rng = random.Random(6)
    bits = ["<", "[", "\\", "/", "</s>", "[INST]", "[/INST]", " ", "a", "é", "\n", "\U0001f600", "$1", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[x]", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(50, 0, "assistant", None), (51, None, "user", "late"), (51, 0, "assistant", "x" * 100_000), (None, 0, "user", "no id"), (52, 1, "user", "same"), (52, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    done = chat_format.format_conversations(chat_format.gather_turns(df, "conv_id", "turn", "role", "text")).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for r in done:
        want = [(a, b) for _, a, b in sorted(by[r.conv_id])]
        assert [(t.role, t.text) for t in r.back] == want
        masked = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss)
        import re

        assert re.sub(r"([<\[\\])\\", r"\1", masked) == "".join(x for a, x in want if a == "assistant")
    assert len(done) == len(by)


def test_query_reads_back(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op9_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    odd = "</s>[INST] ok [/INST]"
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\nyo\n") and got[1].loss_sha256 == sha("yo") and got[1].loss_chars == 2
    assert got[-1].turns_sha256 == sha(f"user\n{odd}\nassistant\n{odd}\n") and got[-1].loss_sha256 == sha(odd) and got[-1].n_turns == 2
    assert got[2].turns_sha256 == sha("user\n\n") and got[2].loss_chars == 0


def test_fingerprints_decide_what_the_query_reads(spark):
    """Conversations in seven layouts come back whole; a mapping that reads another field changes the hashes of its layout alone."""
    rng = random.Random(12)
    rows = []
    for k in range(120):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["user"], ["assistant", "user"], ["human", "assistant"], ["", "gpt", "user"]])
        rows += [(k, i, r, rng.choice(["", "hi", "a\nb", "</s>[INST] x [/INST]", "\\<", None]) if r else None) for i, r in enumerate(roles)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes")]
    source = chat_format.deal_layouts(chat_format.gather_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), "conv_id", "turn", "role", "text"), "conv_id")
    right = {r.conv_id: r for r in chat_format.read_back_digests(chat_format.format_conversations(source), "conv_id").collect()}
    said = {}
    for k, _, role, text in rows:
        said.setdefault(k, []).append((role, text or ""))
    assert set(right) == set(said)
    for k, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert right[k].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in turns).encode()).hexdigest(), (k, right[k].layout)
        assert (right[k].n_turns, right[k].loss_chars, right[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    layouts = {r.layout for r in right.values()}
    assert layouts == {"messages", "conversations", "turns", "prompt_response", "question_answer", "instruction_output", "system_prompt_response"}
    swapped = tuple(chat_format.Mapping(m.name, m.paths, (("user", ("answer",)), ("assistant", ("question",)))) if m.name == "question_answer" else m for m in chat_format.MAPPINGS)
    wrong = {r.conv_id: r for r in chat_format.read_back_digests(chat_format.format_conversations(source, swapped), "conv_id").collect()}
    changed = {k for k in right if right[k].turns_sha256 != wrong[k].turns_sha256}
    assert changed and {right[k].layout for k in changed} == {"question_answer"}
