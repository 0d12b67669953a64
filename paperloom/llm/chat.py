"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's fingerprint is a hash of its nested field paths. It selects a declared layout,
and the layout says where the turns are. Records then share one form, one template.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh

# The template: <|turn|>role<|text|>text<|end|> and a line feed. "<|" occurs nowhere else,
# as texts and roles have it escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"

#: Types that a leaf may have; all of them count as "*", for a null must not change a path.
_LEAF = r"(?:VOID|STRING|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9, ]*\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID)"


def paths_of(shape) -> str:
    """The canonical text of a declared shape, as ``field_paths`` finds it in records."""
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(f"{k}: {paths_of(v)}" for k, v in sorted(shape.items())) + ">"
    if isinstance(shape, list):
        return f"ARRAY<{paths_of(shape[0]) if shape else '*'}>"
    return "*"


def field_paths(record: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(record), rf"(^|: |<){_LEAF}(?=[,>]|$)", "$1*")


def fingerprint(record: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the nested field paths of a VARIANT."""
    return F.substring(F.sha2(field_paths(record), 256), 1, 16)


@dataclass(frozen=True)
class Layout:
    """Where a record of this shape keeps its turns.

    ``items`` is the path of a list with ``role`` and ``text`` inside; without it,
    ``fields`` names (role, path) in order, and several paths of one role are joined by a
    blank line. ``roles`` renames roles.
    """

    name: str
    shape: object
    items: str = ""
    role: str = "role"
    text: str = "content"
    fields: tuple = ()
    roles: dict = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(paths_of(self.shape).encode()).hexdigest()[:16]

    def turns(self, record: Column) -> Column:
        if self.items:
            items = F.coalesce(F.try_variant_get(record, self.items, "array<variant>"), F.array().cast("array<variant>"))
            return F.transform(items, lambda x: _turn(self._named(F.try_variant_get(x, f"$.{self.role}", "string")), F.try_variant_get(x, f"$.{self.text}", "string")))
        out = []
        for role, *paths in self.fields:
            parts = [F.try_variant_get(record, p, "string") for p in paths]
            out.append(_turn(F.lit(role), parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")))
        turns = F.array(*out)
        # a layout with an optional system text leaves it out if it is empty
        return F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))

    def _named(self, role: Column) -> Column:
        expr = role
        for old, new in self.roles.items():
            expr = F.when(role == old, F.lit(new)).otherwise(expr)
        return expr


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


_SHARE = {"human": "user", "gpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Layout("messages", {"messages": [{"role": "*", "content": "*"}]}, items="$.messages"),
    Layout("messages_empty", {"messages": []}, items="$.messages"),
    Layout("message_list", [{"role": "*", "content": "*"}], items="$"),
    Layout("conversations", {"conversations": [{"from": "*", "value": "*"}]}, items="$.conversations", role="from", text="value", roles=_SHARE),
    Layout("conversations_system", {"conversations": [{"from": "*", "value": "*"}], "system": "*"}, items="$.conversations", role="from", text="value", roles=_SHARE),
    Layout("prompt_completion", {"prompt": "*", "completion": "*"}, fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", {"prompt": "*", "response": "*"}, fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("system_prompt_response", {"system": "*", "prompt": "*", "response": "*"}, fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("instruction", {"instruction": "*", "output": "*"}, fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", {"instruction": "*", "input": "*", "output": "*"}, fields=(("user", "$.instruction", "$.input"), ("assistant", "$.output"))),
    Layout("question_answer", {"question": "*", "answer": "*"}, fields=(("user", "$.question"), ("assistant", "$.answer"))),
)


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (array of role, text) to ``df``.

    ``record`` is a VARIANT or a JSON string. A record that is null, no JSON or of no
    declared layout keeps its row, with ``layout`` and ``turns`` null: its fingerprint
    says which layout to declare. Null roles and texts are empty. Columns of these three
    names are replaced.
    """
    own = [c for c in df.columns if c not in ("fingerprint", "layout", "turns")]
    value = F.col(record) if dict(df.dtypes)[record] == "variant" else F.try_parse_json(record)
    (parsed,) = fresh({*own, "fingerprint", "layout", "turns"}, "record")
    at = F.col(parsed)
    out = df.select(*own, value.alias(parsed)).withColumn("fingerprint", fingerprint(at))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed(layouts):
        hit = F.col("fingerprint") == x.fingerprint
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, x.turns(at)).otherwise(turns)
    system = F.try_variant_get(at, "$.system", "string")
    led = F.when((F.col("layout") == "conversations_system") & (F.coalesce(system, F.lit("")) != ""), F.concat(F.array(_turn(F.lit("system"), system)), F.col("turns"))).otherwise(F.col("turns"))
    return out.withColumn("layout", name).withColumn("turns", turns).withColumn("turns", led).drop(parsed)


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no text can then hold a mark."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start, end in code points) from ``turns``.

    A span holds the escaped text of one turn of the ``trained`` role. No turns give an
    empty text; null turns give nulls. Columns of these two names are replaced.
    """
    (pieces,) = fresh({*df.columns, "formatted", "loss_spans"}, "pieces")
    piece = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return (
        df.withColumn(pieces, piece)
        .withColumn("formatted", F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
        .withColumn("loss_spans", F.aggregate(pieces, begin, step, lambda acc: acc["spans"]))
        .drop(pieces)
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: the inverse of ``render``."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def turn(p):
        halves = F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(parts, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, one string for each span."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


PROBE = "\\### Assistant: </turn> ok"


def _shaped(turns: Column) -> Column:
    """A conversation as a record of the layout that its roles allow, so that one table holds many.

    A prompt and its answer, led by a system text or not, are such records; talks of users
    and assistants alone are lists of from and value; all others are messages.
    """
    roles, text = F.transform(turns, lambda t: t["role"]), lambda i: F.element_at(turns, i)["text"]
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    share = F.transform(turns, lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = lambda **of: F.to_variant_object(F.struct(*(c.alias(k) for k, c in of.items())))
    return (
        F.when(is_("user", "assistant"), record(prompt=text(1), response=text(2)))
        .when(is_("system", "user", "assistant") & (text(1) != ""), record(system=text(1), prompt=text(2), response=text(3)))
        .when((F.size(turns) > 0) & F.forall(roles, lambda r: r.isin("user", "assistant")), record(conversations=share))
        .otherwise(record(messages=messages))
    )


def records(conversations: DataFrame) -> DataFrame:
    """``conv_id, record``: rows by turn gathered into nested records of several layouts.

    Rows are ordered by turn, those without one first, then by role and text; a null text
    is empty. The two rows of conversation -7 are added before; where the table has rows
    of that conversation itself, all are one conversation. A conversation is one record,
    so it has to fit into a task's memory, as it has in any training step.
    """
    own = conversations.select("conv_id", "turn", "role", "text")
    kinds = dict(own.dtypes)
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    nested = own.unionByName(probe).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    return nested.select("conv_id", _shaped(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))).alias("record"))


def digest(conversations: DataFrame) -> DataFrame:
    """The rows of query op4, all read back from ``formatted`` and ``loss_spans``."""
    out = render(canonical(records(conversations))).select("conv_id", "layout", "formatted", "loss_spans")
    said = F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        out.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("said", said)
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
