import math

from pyspark.sql import functions as F

from foliant.functions import nested, num, text


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def python_clean(s):
    return " ".join((s or "").replace("\0", " ").split())


def test_clean_text_agrees_with_python_on_every_white_space(spark):
    texts = [f"a{chr(c)}b{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace() or c < 33] + [None, "", " \t\n", "a\0b", "\u00a0x\u3000", "x" * 19, "\U0001f600" * 1001]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.clean_text(F.col("t")).alias("c")).collect()
    assert all(r.c == python_clean(r.t) for r in rows)


def test_strip_html(spark):
    cases = {
        "<p>a</p>": "a",
        "<SCRIPT>x\ny</SCRIPT>b": "b",
        "<style>\n.a{}</style>c &amp; d": "c &amp; d",
        "a<script>1</script>b<script>2</script>c": "a b c",
        "<": "<",
    }
    for given, wanted in cases.items():
        assert one(spark, text.strip_html(F.lit(given))) == wanted
    assert one(spark, text.strip_html(F.lit(None).cast("string"))) == ""


def test_paths(spark):
    for given, wanted in {"/a/b.TXT": ".txt", "x.tar.gz": ".gz", "noext": "", "/a.b/c": "", "C:\\d\\e.Pdf": ".pdf"}.items():
        assert one(spark, text.extension(F.lit(given))) == wanted
    assert one(spark, text.surrogate_id(F.lit("cv"), F.lit(7))) == "cv_0007"
    assert one(spark, text.surrogate_id(F.lit("cv"), F.lit(12345))) == "cv_12345"
    assert one(spark, text.project_relative(F.lit("/r/x/y"), "/r")) == "x/y"
    assert one(spark, text.project_relative(F.lit("/s/x"), "/r")) == "/s/x"
    assert one(spark, text.resolve_path(F.lit("x"), "/r")) == "/r/x"
    names = ["a/b.txt", "a-b/c.txt", "a\\a.txt"]
    got = spark.createDataFrame([(n,) for n in names], "p string").orderBy(text.path_order(F.col("p"))).collect()
    assert [r.p for r in got] == ["a\\a.txt", "a/b.txt", "a-b/c.txt"]
    assert one(spark, text.out_of_memory(F.lit("CUDA error: Out of Memory"))) is True
    assert one(spark, text.strip_space(F.lit("\u00a0 a b\t"))) == "a b"


def test_numbers(spark):
    for given, wanted in {"1.5": 1.5, "": -1.0, "x": -1.0, "1.5d": -1.0, None: -1.0, " 2 ": 2.0, "1e3": 1000.0}.items():
        assert one(spark, num.lenient_double(F.lit(given).cast("string"), -1.0)) == wanted
    assert one(spark, num.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    for given, wanted in {2.5: 2, 0.5: 0, 3.5: 4, -4.0: 0, 1e12: 1000, 999.6: 1000}.items():
        assert one(spark, num.clamp_1000(F.lit(given))) == wanted
    p = one(spark, num.softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    e = [math.exp(x - 3) for x in (1, 3, 3)]
    assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(p, e, strict=True))
    assert one(spark, num.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 2
    assert one(spark, num.argmax(F.array().cast("array<double>"))) is None


def boxes(spark, words, raw, width=200, height=100, clean=text.clean_text):
    df = spark.createDataFrame([(words, raw, width, height)], "w array<string>, b array<array<double>>, x int, y int")
    return df.select(nested.normalize_ocr(F.col("w"), F.col("b"), F.col("x"), F.col("y"), clean).alias("o")).first()["o"]


def test_boxes(spark):
    good = boxes(spark, ["a", " ", "b "], [[0.0, 0.0, 100.0, 50.0], [9.0, 9.0, 1.0, 1.0], [10.0, 10.0, 500.0, 10.0]])
    assert good["error"] is None and good["words"] == ["a", "b"] and good["boxes"] == [[0, 0, 500, 500], [50, 100, 1000, 100]]
    assert "shape" in boxes(spark, ["a"], [[1.0, 2.0, 3.0]])["error"]
    assert "coordinates" in boxes(spark, ["a"], [[5.0, 0.0, 1.0, 1.0]])["error"]
    assert "mismatch" in boxes(spark, ["a", "b"], [[0.0, 0.0, 1.0, 1.0]])["error"]
    assert boxes(spark, [" "], [[0.0, 0.0, 1.0, 1.0]])["error"] == "no readable words"
    assert boxes(spark, ["a"], [[0.0, 0.0, 1.0, 1.0]], 0)["error"] == "page without extent"
    assert boxes(spark, None, None)["error"].startswith("words and boxes")
    half = boxes(spark, ["a"], [[0.5, 2.5, 0.5, 2.5]], 1000, 1000)
    assert half["boxes"] == [[0, 2, 0, 2]]


def test_ocr_json(spark):
    def load(s):
        return one(spark, nested.load_ocr(F.lit(s), F.lit(200), F.lit(100)))

    assert load('{"words":["a"],"boxes":[[0,0,100,50]]}')["boxes"] == [[0, 0, 500, 500]]
    assert load('{"words":["a"],"boxes":[[0,0,100,50]],"image_width":"400","image_height":-1}')["boxes"] == [[0, 0, 250, 500]]
    assert load("not json")["error"] and load('{"words":[],"boxes":[]}')["error"] == "no readable words"


def test_payloads(spark):
    cols = [F.array(*map(F.lit, v)) for v in (["a", "", " b"], [1, 2, 3], [1, 2, 3], [5, 5, 5], [6, 6, 6], ["90.5", "x", ""])]
    p = nested.assemble_payload(F.lit("cv"), *cols, F.lit(3))
    got = one(spark, p)
    assert got["words"] == ["a", "b"] and got["boxes"] == [[1, 1, 6, 7], [3, 3, 8, 9]] and got["confidences"] == [90.5, None] and got["page_indices"] == [3, 3]
    merged = one(spark, nested.merge_payloads(F.lit("cv"), F.array(p, nested.empty_payload(F.lit("cv")), p)))
    assert merged["words"] == ["a", "b", "a", "b"]
    assert one(spark, nested.payload_text(p)) == "a b"


def test_maps(spark):
    forward, back = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(1)), F.create_map(F.lit("1"), F.lit("b"), F.lit("0"), F.lit("a"))
    wrong = F.create_map(F.lit("1"), F.lit("a"), F.lit("0"), F.lit("b"))
    assert one(spark, nested.mapping_consistent(forward, back)) is True and one(spark, nested.mapping_consistent(forward, wrong)) is False
    assert one(spark, nested.invert_map(forward)) == {0: "a", 1: "b"}
    assert one(spark, nested.keep_keys(forward, ["b", "c"])) == {"b": 1}


def greedy(s, width):
    lines, line = [], ""
    for w in s.split():
        longer = f"{line} {w}".strip()
        if len(longer) <= width:
            line = longer
        else:
            if line:
                lines.append(line)
            line = w
    return lines + [line] if line else lines


def test_wrap(spark):
    for s in ("", "a", "aa bb cc dd", "x" * 12 + " y z", "a " + "b" * 30 + " c"):
        assert one(spark, nested.wrap_words(F.lit(s), 8)) == greedy(s, 8)
    assert one(spark, F.size(nested.page_lines(F.lit("word " * 5000)))) == 42
