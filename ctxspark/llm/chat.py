"""Chat formatting by schema fingerprinting.

A record's nested field paths (``a``, ``a.b`` for an object, ``a[].b`` for an array of objects) are reduced to those that
some mapping knows, sorted, joined and hashed. The hash selects a declarative mapping, which says where the turns are.
Records may be JSON strings (a fingerprint per row) or structs (one fingerprint for the column, from its type).

The template writes ``<|start|>role<|message|>text<|end|>`` per turn. Control strings of this and other common templates
inside a role or text get one more backslash after their first character, which ``unescape`` takes away again, so the
markers of the template are the only ones in the output.

Edge cases: null records, invalid JSON and unknown layouts have layout null and no turns; null roles and texts are empty;
turns keep their order and repeats; an unknown role is kept as it is; extra fields don't change the fingerprint; texts of any
length are kept whole; repeated records have results of their own; other columns are carried in a struct, so that no name
clashes; a conversation without turns is the empty string; no rows give no rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, text_or_empty

TURN = "array<struct<role:string,text:string>>"
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"

#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: Layouts: "list" names an array of turns with the fields for role and text; "fields" gives each turn its role and the
#: fields whose non-empty values are joined by an empty line. "optional" fields may be missing.
MAPPINGS = {
    "messages": {"list": ("messages", "role", "content")},
    "sharegpt": {"list": ("conversations", "from", "value")},
    "turns": {"list": ("turns", "role", "text")},
    "dialog": {"list": ("dialog", "speaker", "utterance")},
    "alpaca": {"fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])], "optional": ["system", "input"]},
    "prompt_response": {"fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])], "optional": ["system"]},
    "prompt_completion": {"fields": [("user", ["prompt"]), ("assistant", ["completion"])], "optional": []},
    "question_answer": {"fields": [("user", ["context", "question"]), ("assistant", ["answer"])], "optional": ["context"]},
}

#: The first character, the backslashes so far, and the rest of a control string.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, CONTROL, r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, ESCAPED, "$1$2$3")


def _paths(mapping: dict) -> list[list[str]]:
    """The path sets that a mapping accepts, one for each choice of its optional fields."""
    if "list" in mapping:
        at, role, text = mapping["list"]
        return [[at, f"{at}[].{role}", f"{at}[].{text}"]]
    needed = [f for _, fields in mapping["fields"] for f in fields if f not in mapping["optional"]]
    return [needed + [f for f, on in zip(mapping["optional"], keep) if on] for keep in product([0, 1], repeat=len(mapping["optional"]))]


KNOWN = sorted({p for m in MAPPINGS.values() for ps in _paths(m) for p in ps})


def _hash(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def json_fingerprint(js: Column) -> Column:
    """The hash of a JSON record's known field paths; null for what isn't a JSON object."""
    deep = lambda k, v: F.when(v.startswith("{"), F.transform(F.json_object_keys(v), lambda c: F.concat(k, F.lit("."), c))).when(
        v.startswith("["),
        F.transform(F.array_distinct(F.flatten(F.transform(F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))), lambda c: F.concat(k, F.lit("[]."), c)),
    )
    entries = F.map_entries(F.from_json(js, "map<string,string>"))
    paths = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["key"]), F.coalesce(deep(e["key"], e["value"]), F.array().cast("array<string>")))))
    known = F.array(*[F.lit(p) for p in KNOWN])
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.filter(paths, lambda p: F.array_contains(known, p)))), "\n"))


def _type_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.ArrayType):
        return _type_paths(kind.elementType, f"{at}[]")
    return [p for f in kind.fields for here in [f"{at}.{f.name}" if at else f.name] for p in [here, *_type_paths(f.dataType, here)]] if isinstance(kind, T.StructType) else []


def struct_fingerprint(kind: T.StructType) -> Column:
    return _hash([p for p in _type_paths(kind) if p in KNOWN])


def _turns(mapping: dict, rec: Column, kind: T.DataType) -> Column:
    """The turns of a record by one mapping; kind: the record's type."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    is_json = isinstance(kind, T.StringType)
    if "list" in mapping:
        at, role, text = mapping["list"]
        rows = F.from_json(F.get_json_object(rec, f"$.{at}"), f"array<struct<`{role}`:string,`{text}`:string>>") if is_json else rec[at]
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        named = (lambda c: F.coalesce(names[c], c)) if mapping is not MAPPINGS["turns"] else (lambda c: c)
        return F.transform(rows, lambda t: F.struct(named(said(t[role])).alias("role"), said(t[text]).alias("text")))
    field = lambda f: F.get_json_object(rec, f"$.{f}") if is_json else rec[f] if f in kind.names else F.lit(None).cast("string")
    turns = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[field(f) for f in fields]), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text")) for role, fields in mapping["fields"]]
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical(df: DataFrame, record: str) -> DataFrame:
    """Every row of df as the struct `row`, with fingerprint long, layout string and turns (role, text) of the record column, a JSON
    string or a struct."""
    kind = df.schema[record].dataType
    df = packed(df, rec=F.col(f"`{record}`"))
    rec = F.col("rec")
    prints = json_fingerprint(rec) if isinstance(kind, T.StringType) else F.when(rec.isNotNull(), struct_fingerprint(kind))
    df = df.withColumn("fingerprint", prints)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    have = {p for p in _type_paths(kind)} if isinstance(kind, T.StructType) else None
    for name, mapping in MAPPINGS.items():
        if have is not None and not any(set(ps) <= have for ps in _paths(mapping)):
            continue
        hit = F.col("fingerprint").isin(*[_hash(ps) for ps in _paths(mapping)])
        layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, _turns(mapping, rec, kind)).otherwise(turns)
    return df.select("row", "fingerprint", layout.alias("layout"), F.coalesce(turns, F.array().cast(TURN)).alias("turns"))


def formatted(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Every row of df as the struct `row`, with formatted string and loss_mask: for each turn how many code points of the output
    are skipped, learned, and skipped after them. The numbers sum to the length of the output; only texts of the role to learn are learned."""
    size = lambda c: F.char_length(c).cast("int")
    df = packed(df, turns=F.col(f"`{turns}`"))
    safe = F.transform(F.coalesce(F.col("turns"), F.array().cast(TURN)), lambda t: F.struct(escape(text_or_empty(t["role"])).alias("role"), escape(text_or_empty(t["text"])).alias("text"), F.coalesce(t["role"] == learn, F.lit(False)).alias("loss")))
    head = lambda t: F.lit(len(START) + len(MESSAGE)) + size(t["role"])
    return (
        df.withColumn("_safe", safe)
        .withColumn("formatted", F.array_join(F.transform("_safe", lambda t: F.concat(F.lit(START), t["role"], F.lit(MESSAGE), t["text"], F.lit(END))), ""))
        .withColumn("loss_mask", F.transform("_safe", lambda t: F.struct(F.when(t["loss"], head(t)).otherwise(head(t) + size(t["text"])).alias("skip"), F.when(t["loss"], size(t["text"])).otherwise(F.lit(0)).alias("learn"), F.lit(len(END)).alias("tail"))))
        .select("row", "formatted", "loss_mask")
    )


def read_back(df: DataFrame) -> DataFrame:
    """Every row of df as the struct `row`, with back (role, text, learned text) per turn, from its formatted and loss_mask alone;
    the inverse of ``formatted``."""
    df = packed(df, formatted=F.col("formatted"), loss_mask=F.col("loss_mask"))
    quoted = lambda s: s.replace("|", r"\|")
    pieces = F.split(F.col("formatted"), quoted(END))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    back = F.transform(
        F.arrays_zip(pieces.alias("piece"), F.col("loss_mask").alias("mask")),
        lambda z: F.struct(
            unescape(F.substring(F.split(z["piece"], quoted(MESSAGE))[0], len(START) + 1, 2**31 - 1)).alias("role"),
            unescape(F.split(z["piece"], quoted(MESSAGE))[1]).alias("text"),
            unescape(F.substring(z["piece"], z["mask"]["skip"] + 1, z["mask"]["learn"])).alias("learned"),
        ),
    )
    return df.select("row", back.alias("back"))


def rows_to_records(rows: DataFrame) -> DataFrame:
    """Conversations stored by turn (conv_id, turn, role, text) as records conv_id, record: the layout ``turns``. Turns are
    ordered by turn, then role, then text, nulls first; a null conv_id is one conversation."""
    said = F.struct("turn", "role", "text")
    return rows.groupBy("conv_id").agg(F.struct(F.array_sort(F.collect_list(said)).alias("turns")).alias("record"))


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    df = read_back(formatted(canonical(rows_to_records(rows.unionByName(extra)), "record")))
    learned = F.array_join(F.transform("back", lambda t: t["learned"]), "")
    return df.select(
        "row.row.row.conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("row.formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace({}, '([<\[])(\\*)(\|[A-Za-z0-9_]{{1,32}}\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"

OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(MESSAGE) + len(END)} + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
