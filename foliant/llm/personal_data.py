"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, and a span classifier is fitted on the result."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Spans of the sample that the classifier is fitted on, about; its features; the probability from which a span is added.
SAMPLE, FEATURES, LIMIT = 20_000, 1 << 12, 0.8
#: Characters of context that labelers and features see on either side.
LEFT, RIGHT = 48, 16

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a text needs to hold any span, in the syntax of RE2.
_ANY = r"[0-9@]|(?i:[(\[{<] ?(at|arroba) ?[)\]}>]| at .{1,80} dot )"

_AT, _DOT = r"(?: ?[(\[{<] ?(?i:at|arroba|@) ?[)\]}>] ?)", r"(?: ?[(\[{<] ?(?i:dot|punkt|point|punto) ?[)\]}>] ?)"
_OTHER = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT}| dot )[A-Za-z0-9-]{{1,63}}){{1,5}}| at [A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}| dot )[A-Za-z0-9-]{{1,63}}){{1,5}})"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ ][0-9]{4}){2}[./_ ][0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"\+[0-9]{1,2} ?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+.,:/-])(?:\([0-9]{2,5}\)[ -]?|[0-9]{2,5}[ ./-])(?:[0-9]{2,5}[ ./-]){0,4}[0-9]{2,8}(?![0-9A-Za-z]|[.,/-][0-9])"),
}

#: Gazetteers. Words beside a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail email e-mail contact write kontakt schreiben courriel contacter correo escribir",
    "ip": "ip ipv6 ipv4 host server ping ssh login address rechner adresse serveur servidor",
    "card": "card visa mastercard amex credit debit karte kreditkarte carte tarjeta pan",
    "phone": "phone tel telephone call mobile cell fax whatsapp sms telefon handy anruf rufnummer mobil téléphone portable appeler teléfono móvil llamar",
}
AGAINST = "version release build isbn issn invoice order rechnung facture factura page seite página date datum fecha section chapter sku id serial figure table line"
_CUES, _AGAINST = {k: frozenset(v.split()) for k, v in CUES.items()}, frozenset(AGAINST.split())
#: Top-level domains that speak for a mail address; first digits of cards; trunk and country prefixes of phones.
_TLDS = frozenset("com org net edu gov info io de fr es uk it nl eu ch at us ca au br mx pl se".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38")
_PREFIXES = re.compile(r"0[1-9]|00[1-9]|1[2-9][0-9]{9}$|[2-9][0-9]{2}[2-9][0-9]{6}$")
_SHAPES = {
    "email": re.compile(rf".*{_AT}.*|.* at .* dot (?:com|org|net|edu|de|fr|es|uk|io)"),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|.*::.*"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ ./_ -])[0-9]{4})(?:\1[0-9]{4}){1,2}(?:\1[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?[ /-][0-9 -]{5,10}|\(?00[0-9 -]{9,16}|0[0-9](?:[ .][0-9]{2}){4}"),
}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./ -][01]?[0-9][./ -][0-3]?[0-9]|[0-3]?[0-9][./ -][01]?[0-9][./ -](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ /-](?:19|20)[0-9]{2}")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    twice = sum(d - 9 * (d > 9) for d in (2 * int(c) for c in digits[-2::-2]))
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the longest run of local characters since the last match, and the domain. Takes time with the length alone."""
    free, p = 0, text.find("@")
    while p >= 0:
        own = text[free:p]
        start = free + len(own.rstrip(_LOCAL))
        m = _DOMAIN.match(text, p + 1) if start < p else None
        if m:
            yield start, m.end()
        free = m.end() if m else p + 1  # no local run holds an @
        p = text.find("@", free)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans that always count, per kind, leftmost and without overlap within a kind; matches that fail their test are dropped."""
    chains = ((m, _digits(m.group())) for m in _CHAIN.finditer(text))
    return {
        "email": list(_emails(text)),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m, d in chains if 13 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15],
    }


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, end, known): base spans (known 1), what can't be of its kind (known 0), and spans that the method decides (-1).

    Undecided ones never overlap a base span. Numbers of a card's length that fail the checksum, dates among digit groups and texts with
    colons that are no address are known not to be personal. A phone at the start of a base match that has too many digits is undecided.
    """
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []

    def free(a: int, b: int) -> bool:
        at = np.searchsorted(starts, b, "left")
        return at == 0 or reach[at - 1] <= a

    for kind in KINDS:
        for a, b in base[kind]:
            yield kind, a, b, 1
    for m in _CHAIN.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and not luhn(d):
            yield "card", *m.span(), 0
    for kind, pattern in _OTHER.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if free(a, b):
                d, known = _digits(m.group()), -1
                if kind == "phone" and not 7 <= len(d) <= 15 or kind == "card" and not 13 <= len(d) <= 19:
                    continue
                if kind == "phone" and _DATE.fullmatch(m.group()) or kind == "card" and not luhn(d) or kind == "ip" and not (_address(m.group()) and len(m.group()) >= 9):
                    known = 0
                yield kind, a, b, known


def _address(s: str) -> bool:
    try:
        return bool(ipaddress.ip_address(s))
    except ValueError:
        return False


def _context(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    return [w.lower() for w in _WORDS.findall(text[max(0, a - LEFT) : a])][-4:], [w.lower() for w in _WORDS.findall(text[b : b + RIGHT])][:2]


#: A labeler says 1 (personal), -1 (not) or 0 (nothing) of (kind, span, words before, words after).
def _by_shape(kind, s, before, after):
    return 1 if s[:1] == "+" or "@" in s or _SHAPES[kind].fullmatch(s) else -1 if _DATE.fullmatch(s) else 0


def _by_gazetteer(kind, s, before, after):
    if kind == "email":
        return 1 if _WORDS.findall(s)[-1:] and _WORDS.findall(s)[-1].lower() in _TLDS else -1
    if kind == "ip":
        return 1 if _address(s) else -1
    d = _digits(s)
    return 1 if s[:1] == "+" or (_ISSUERS if kind == "card" else _PREFIXES).match(d) else -1


def _by_cue(kind, s, before, after):
    return 1 if _CUES[kind] & set(before) else 0


def _by_other_cue(kind, s, before, after):
    return -1 if _AGAINST & set(before[-2:]) or any(_CUES[k] & set(before[-1:]) for k in KINDS if k != kind) else 0


def _by_neighbour(kind, s, before, after):
    return -1 if set(after[:1]) & {"kg", "km", "mm", "cm", "eur", "euro", "euros", "usd", "percent", "prozent", "pages", "seiten"} else 0


def _by_checksum(kind, s, before, after):
    d = _digits(s)
    if kind == "card":
        return 1 if luhn(d) else -1
    return (1 if 9 <= len(d) <= 12 else -1 if len(d) < 8 else 0) if kind == "phone" else 0


LABELERS = (_by_shape, _by_gazetteer, _by_cue, _by_other_cue, _by_neighbour, _by_checksum)


def votes(kind: str, s: str, before: list[str], after: list[str]) -> int:
    """The labelers' votes as one number, a digit of base 3 each."""
    return sum((f(kind, s, before, after) + 1) * 3**i for i, f in enumerate(LABELERS))


def features(kind: str, s: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed: triples of the span's shape, its length, and the words around it, each with the kind."""
    shape = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in s[:64])
    shape = re.sub(r"a{3,}", "aa", shape)
    named = [kind, f"{kind} n {min(len(_digits(s)), 20)}", *(f"{kind} s {x}" for x in {f"^{shape}$"[i : i + 3] for i in range(len(shape))}), *(f"{kind} b {w}" for w in before[-2:]), *(f"{kind} a {w}" for w in after[:1])]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in named})


def log_odds(patterns: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """How much the votes speak for personal data: a labeler that is right with probability r weighs log(r / (1 - r)); silence weighs nothing."""
    vote = np.asarray(patterns)[..., None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    return np.log(share / (1 - share)) + (vote * np.log(right / (1 - right))).sum(axis=-1)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(how often each labeler is right when it speaks, share of personal spans among the undecided), by expectation-maximisation.

    Rows: a pattern of votes, how many spans have it, and the truth where it is known (1 or 0, else -1). Pseudocounts (right four times in
    five, one undecided span in five personal) keep what few spans say from becoming certain. A labeler that is wrong more often than right counts nothing,
    and not against what it says.
    """
    vote = patterns[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    right, share, undecided = np.full(len(LABELERS), 0.8), 0.2, known < 0
    for _ in range(rounds):
        p = np.where(undecided, _logistic(log_odds(patterns, right, share)), known)
        share = float((10 * 0.2 + (p * counts)[undecided].sum()) / (10 + counts[undecided].sum()))
        good = (np.where(vote > 0, p[:, None], np.where(vote < 0, 1 - p[:, None], 0)) * counts[:, None]).sum(axis=0)
        right = np.maximum(0.5, (4 + good) / (5 + ((vote != 0) * counts[:, None]).sum(axis=0)))
    return right, share


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Per kind the labelers' reliabilities and the share of personal spans; and the classifier's weights."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, float]], weights: np.ndarray):
        self.tables, self.weights = tables, weights

    def votes_say(self, kind: str, pattern: int) -> float:
        right, share = self.tables.get(kind, (np.full(len(LABELERS), 0.8), 0.2))
        return float(log_odds(np.array(pattern), right, share))

    def probability(self, kind: str, s: str, before: list[str], after: list[str]) -> float:
        seen = (kind, s, before, after)
        return float(_logistic(self.votes_say(kind, votes(*seen)) + self.weights[features(*seen)].sum()))


def fit(rows: list[tuple[list[int], float, float]], rounds: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of (hashed features, log odds of the votes, soft label), by gradient steps of falling size.
    The votes' log odds are part of the model with weight 1; the features correct them."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    at, row = np.concatenate([np.array(f) for f, _, _ in rows]), np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    odds, y, seen = np.array([o for _, o, _ in rows]), np.array([p for _, _, p in rows]), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = _logistic(odds + np.bincount(row, w[at], len(rows)))
        g = np.bincount(at, (p - y)[row], FEATURES) + ridge * w
        seen += g * g
        w -= 0.1 * g / np.sqrt(seen)
    return w


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(place, text) of those that may hold a span; RE2 picks them before they become Python's."""
    hit = pc.fill_null(pc.match_substring_regex(column, _ANY), False)
    at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
    for k in range(0, len(at), 256):
        yield from zip(at[k : k + 256].tolist(), column.take(pa.array(at[k : k + 256])).to_pylist(), strict=True)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and features of every candidate."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for _, text in _texts(b.column(0)):
            mark = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            for kind, start, end, known in candidates(text, base_spans(text)):
                seen = (kind, text[start:end], *_context(text, start, end))
                for column, x in zip(out, (KINDS.index(kind), known, votes(*seen), zlib.crc32(b"%d" % start, mark), features(*seen)), strict=True):
                    column.append(x)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["kind", "known", "votes", "mark", "features"])


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Reliabilities from the candidates of all texts, and a classifier fitted on about ``sample`` candidates, taken by a hash of text and place.

    The counts of vote patterns cover every candidate and reach the driver as one row for each kind, known truth and pattern, of which there
    are 3 ** labelers at most. The classifier's labels are what is known, or the probability that the votes give.
    """
    scratch = Scratch(df.sparkSession, "personal-data")
    found = scratch.put(df.where(F.col(text).isNotNull()).select(F.col(text).cast("string")).mapInArrow(_collect, "kind int, known int, votes int, mark bigint, features array<int>"), "candidates")
    counts = found.groupBy("kind", "known", "votes").count().toPandas().sort_values(["kind", "known", "votes"])
    tables = {KINDS[k]: reliabilities(own["votes"].to_numpy(), own["count"].to_numpy(np.float64), own["known"].to_numpy()) for k, own in counts.groupby("kind")}
    rate = min(1.0, sample / max(1, int(counts["count"].sum())))
    drawn = found.where(F.col("mark") < int(rate * 2**32)).select("kind", "known", "votes", "features").collect() if len(counts) else []
    scratch.drop("candidates")
    rows = []
    for r in drawn:
        odds = float(log_odds(np.array(r.votes), *tables[KINDS[r.kind]]))
        rows.append((list(r.features), odds, float(r.known if r.known >= 0 else _logistic(odds))))
    return Model(tables, fit(sorted(rows)))


def added(text: str, base: dict[str, list[tuple[int, int]]], model: Model, limit: float) -> list[tuple[int, int, int]]:
    """(kind, start, end) of undecided candidates that the classifier takes; of two that overlap the likelier, then the first."""
    likely = []
    for kind, a, b, known in candidates(text, base):
        if known < 0 and (p := model.probability(kind, text[a:b], *_context(text, a, b))) >= limit:
            likely.append((-p, a, b, KINDS.index(kind)))
    out: list[tuple[int, int, int]] = []
    for _, a, b, k in sorted(likely):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((k, a, b))
    return out


def _detect(model: Model, limit: float, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base: list[list] = [[] for _ in range(len(b))]
            more: list[list] = [[] for _ in range(len(b))]
            for i, text in _texts(b.column(at_text)):
                found = base_spans(text)
                base[i] = [(k, *s) for k, kind in enumerate(KINDS) for s in found[kind]]
                more[i] = added(text, found, model, limit)
            kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            form = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, form(base), form(more)], [*b.schema.names, "base_spans", "added_spans"])

    return run


def detect(df: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """Adds base_spans and added_spans, arrays of (kind: place in KINDS, start, end) in code points, end exclusive, to every row.

    Base spans come by kind and start and always stay; added ones overlap no base span and none another. Null or empty text: none. Columns of
    these two names are replaced; rows are neither added nor dropped. Takes time with a text's length, and any text may repeat.
    """
    df = df.drop("base_spans", "added_spans")
    spans, plain = "array<struct<kind:int,start:bigint,end:bigint>>", [f"c{i}" for i in range(len(df.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema, strict=True)) + f", base_spans {spans}, added_spans {spans}"
    return df.toDF(*plain).mapInArrow(_detect(model, limit, df.columns.index(text)), schema).toDF(*df.columns, "base_spans", "added_spans")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k]}]"]
            end = b
    return "".join(out) + text[end:]


def digests(found: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256 and spans (all spans, as kind:start:end by kind and start)."""
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    count = {f"n_{kind}": of(k) for k, kind in enumerate(KINDS)}
    return found.withColumns(count | {"n_added": F.size("added_spans").cast("bigint"), "base_sha256": F.sha2(joined(F.col("base_spans")), 256), "spans": joined(F.array_sort(F.concat("base_spans", "added_spans")))}).drop("base_spans", "added_spans")


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the base spans and those that the method adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(detect(docs, train(docs))).drop("text")
