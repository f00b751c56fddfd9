"""Chat formatting: field-path fingerprints choose declarative mappings to canonical turns (DataFrame functions only)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. paths: the nested field paths that it has. turns: for a list (list column, role field, text
    field), or (role, column) pairs of a flat layout, in order. roles: names of the layout's roles in canonical form."""

    name: str
    paths: tuple[str, ...]
    turns: tuple
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), ("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value"), _NAMES),
    Mapping("turns", ("turns[].speaker", "turns[].text"), ("turns", "speaker", "text"), _NAMES),
    Mapping("prompt_response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("question", "answer"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction_output", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input_output", ("instruction", "input", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
)

CANONICAL = "array<struct<role:string,text:string>>"

#: Fixed values of the template: a turn is [INST] role [/INST]text</s>.
OPEN, MIDDLE, CLOSE = "[INST] ", " [/INST]", "</s>"


def field_paths(kind: T.DataType, at: str) -> list[str]:
    """Every leaf path below a type; [] marks a step into a list."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}")]
    return [at]


def fingerprint(df: DataFrame, mappings=MAPPINGS) -> Column:
    """sha256 of the sorted nested field paths that a row has, among the top fields that any mapping knows.

    A row has the paths of a top field that isn't null. Fields that no mapping knows don't count, so extra columns do no harm.
    """
    roots = {p.split("[")[0].split(".")[0] for m in mappings for p in m.paths}
    have = [(f.name, field_paths(f.dataType, f.name)) for f in df.schema.fields if f.name in roots]
    lists = [F.when(F.col(f"`{name}`").isNotNull(), F.array(*map(F.lit, paths))).otherwise(F.array().cast("array<string>")) for name, paths in have]
    paths = F.array_sort(F.flatten(F.array(*lists))) if lists else F.array().cast("array<string>")
    return F.sha2(F.array_join(paths, "\n"), 256)


def _turns(m: Mapping) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    def renamed(role: Column) -> Column:
        out = role
        for old, new in m.roles:
            out = F.when(role == old, new).otherwise(out)
        return out

    if isinstance(m.turns[0], str):
        column, role, text = m.turns
        return F.transform(F.col(column), lambda x: turn(renamed(x[role]), x[text]))
    return F.array(*(turn(F.lit(role), F.concat_ws("\n", *(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns))) for role, columns in m.turns))


def canonical_turns(df: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Adds layout (the mapping's name) and turns (list of role and text).

    The row's fingerprint selects the mapping. A layout that no mapping has: both null, the row stays. Null role or text: empty;
    an empty list gives no turns. Columns named layout and turns are read as input before they are replaced.
    """
    columns, layout, turns = set(df.columns), F.lit(None).cast("string"), F.lit(None).cast(CANONICAL)
    mark = fingerprint(df, mappings)
    for m in mappings:
        if {p.split("[")[0].split(".")[0] for p in m.paths} <= columns and _fits(df, m):
            layout = F.when(mark == m.fingerprint, m.name).otherwise(layout)
            turns = F.when(mark == m.fingerprint, _turns(m)).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns})


def _fits(df: DataFrame, m: Mapping) -> bool:
    if not isinstance(m.turns[0], str):
        return True
    kind = df.schema[m.turns[0]].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and set(m.turns[1:]) <= set(kind.elementType.names)


def escape(text: Column) -> Column:
    """A backslash after every <, [ and backslash, so that no control string of the template stands in a text."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))), "")


def read_back(formatted: Column) -> Column:
    """The turns that stand in a formatted conversation: list of role, text and the text's length as it stands there."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text"), F.length(F.regexp_extract(p, head, 2)).alias("shown")))


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Where the loss applies: list of (start, length) in code points of the formatted conversation, one for each turn of the role."""
    shown = F.transform(turns, lambda t: F.struct(F.length(escape(t["role"])).alias("r"), F.length(escape(t["text"])).alias("n"), (t["role"] == role).alias("on")))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(len(OPEN) + len(MIDDLE)) + t["r"]
        own = F.struct(start.cast("bigint").alias("start"), t["n"].cast("bigint").alias("length"))
        return F.struct((start + t["n"] + F.lit(len(CLOSE))).cast("bigint").alias("at"), F.when(t["on"], F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(shown, empty, step, lambda acc: acc["spans"])


def format_conversations(df: DataFrame, mappings=MAPPINGS, loss_role: str = "assistant") -> DataFrame:
    """Adds layout, turns, formatted and loss (spans) to rows of any known layout; null where the layout is unknown."""
    out = canonical_turns(df, mappings)
    return out.withColumns({"formatted": render(F.col("turns")), "loss": loss_spans(F.col("turns"), loss_role)})


def gather_turns(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Rows by turn as one message list for each key. Ties go by role, then text; null turns come first; repeated rows stay."""
    row = F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def deal_layouts(gathered: DataFrame, key: str) -> DataFrame:
    """The message lists of ``gather_turns`` as they come from sources of several layouts, by the turns' roles and the key.

    A user's and an assistant's turn become prompt and response, question and answer, or instruction and output; with a system's turn before them
    system, prompt and response; all others a list of messages, of conversations (from, value, with other names for roles) or of turns (speaker, text).
    A conversation that has one of those other names as a role stays a list of messages. The columns of all other layouts are null.
    """
    roles, text = F.transform("messages", lambda m: m["role"]), lambda i: F.col("messages")[i]["content"]
    is_pair = lambda *names: roles == F.array(*map(F.lit, names))
    rest, two, three = F.pmod(F.col(key), F.lit(3)), is_pair("user", "assistant"), is_pair("system", "user", "assistant")
    free = ~two & ~three & ~F.arrays_overlap(roles, F.array(*(F.lit(old) for old, _ in _NAMES)))
    from_, turns = F.coalesce(free & (rest == 1), F.lit(False)), F.coalesce(free & (rest == 2), F.lit(False))
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    pair = lambda k: F.coalesce(two & (rest == k), F.lit(False))
    lists = ~(from_ | turns | three | pair(0) | pair(1) | pair(2))
    return gathered.select(
        key,
        F.when(lists, F.col("messages")).alias("messages"),
        F.when(from_, F.transform("messages", lambda m: F.struct(named(m["role"]).alias("from"), m["content"].alias("value")))).alias("conversations"),
        F.when(turns, F.transform("messages", lambda m: F.struct(m["role"].alias("speaker"), m["content"].alias("text")))).alias("turns"),
        F.when(three, text(0)).alias("system"),
        F.when(pair(0), text(0)).when(three, text(1)).alias("prompt"),
        F.when(pair(0), text(1)).when(three, text(2)).alias("response"),
        F.when(pair(1), text(0)).alias("question"),
        F.when(pair(1), text(1)).alias("answer"),
        F.when(pair(2), text(0)).alias("instruction"),
        F.when(pair(2), text(1)).alias("output"),
    )


def read_back_digests(done: DataFrame, key: str) -> DataFrame:
    """(key, layout, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations, all read back from the formatted text."""
    back = done.select(key, "layout", "formatted", "loss", read_back(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return back.select(
        key,
        "layout",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, dealt over seven layouts that their fingerprints tell apart."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    source = deal_layouts(gather_turns(rows.unionByName(own), "conv_id", "turn", "role", "text"), "conv_id")
    return read_back_digests(format_conversations(source), "conv_id").drop("layout")


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(7 + 8 + 4 + length(regexp_replace(role, '([<\[\\])', '\1' || chr(92) || chr(92), 'g')) + length(regexp_replace(text, '([<\[\\])', '\1' || chr(92) || chr(92), 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
