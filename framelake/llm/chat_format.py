"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A record is a JSON object. Its nested field paths (keys, and keys of the objects in its lists) are sorted, joined and
hashed; the hash picks a declarative mapping, which says where turns, roles and texts stand. Canonical turns are then
written in one template:

    <|turn|>role<|text|>text<|end|>

Control strings of this and of other common templates inside roles and texts get a backslash after their first
character; those that have backslashes there already get one more, so taking one away restores every text. The loss
mask is an array parallel to the template's parts (head, text, end of each turn): the length of each part and whether
it counts; only assistant texts do.

The query's records come in seven layouts (records_of), and nothing but the fingerprint tells them apart.

Records whose fingerprint no mapping knows keep a row with null turns and a null text. A null record, or one that is
no object, counts as such. Null texts are empty, null roles ''. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: Control strings that are escaped: <|name|>, <s>, </s>, [INST], [/INST], <SYS>>, </SYS>>.
_TAIL = r"(\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand.

    listed: (list, role key, text key); or fixed: (role, keys joined by a blank line) in order. extra: paths that may
    be there too. aliases: canonical names of roles.
    """

    name: str
    paths: tuple[str, ...]
    extra: tuple[str, ...] = ()
    listed: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()


ALIASES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), ("id", "source", "messages[].name"), listed=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), ("id", "system"), listed=("conversations", "from", "value"), fixed=(("system", ("system",)),), aliases=ALIASES),
    Layout("dialog", ("dialog", "dialog[].speaker", "dialog[].text"), ("id",), listed=("dialog", "speaker", "text"), aliases=ALIASES),
    Layout("prompt_response", ("prompt", "response"), ("id", "system", "source"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), ("id", "system", "source"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system", "source"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("answer", "question"), ("id", "context", "source"), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def known_fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """The fingerprint of every layout with any of its extra paths."""
    return {fingerprint_of(x.paths + more): x.name for x in layouts for n in range(len(x.extra) + 1) for more in combinations(x.extra, n)}


def schema_fingerprint(record: Column) -> Column:
    """The hash of a JSON record's sorted nested field paths; null for what is no object."""
    keys = F.json_object_keys(record)
    under = lambda k: F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("']")))
    listed = lambda k: F.flatten(F.transform(F.from_json(under(k), "array<map<string,string>>"), lambda m: F.coalesce(F.map_keys(m), F.expr("cast(array() as array<string>)"))))
    inner = F.flatten(F.transform(keys, lambda k: F.transform(F.when(F.substring(F.ltrim(under(k)), 1, 1) == "[", F.array_distinct(listed(k))).otherwise(F.expr("cast(array() as array<string>)")), lambda s: F.concat(k, F.lit("[]."), s))))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.concat(keys, F.coalesce(inner, F.expr("cast(array() as array<string>)"))))), "|"), 256)


def _superset(layouts: tuple[Layout, ...]) -> str:
    lists: dict[str, set[str]] = {}
    plain: set[str] = set()
    for x in layouts:
        if x.listed:
            lists.setdefault(x.listed[0], set()).update(x.listed[1:])
        plain.update(k for _, keys in x.fixed for k in keys)
    fields = [f"`{k}`: array<struct<{', '.join(f'`{s}`: string' for s in sorted(v))}>>" for k, v in lists.items()] + [f"`{k}`: string" for k in sorted(plain)]
    return f"struct<{', '.join(fields)}>"


def _turns(r: Column, layout: Layout) -> Column:
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))
    fixed = [turn(F.lit(role), F.when(F.coalesce(*[r[k] for k in keys]).isNotNull(), F.array_join(F.filter(F.array(*[r[k] for k in keys]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n"))) for role, keys in layout.fixed]
    out = F.filter(F.array(*fixed), lambda t: t["text"].isNotNull()) if fixed else None
    if layout.listed:
        name, role, text = layout.listed
        canonical = lambda c: F.coalesce(*[F.when(c == a, F.lit(b)) for a, b in layout.aliases], c)
        rows = F.transform(r[name], lambda x: turn(canonical(x[role]), F.coalesce(x[text], F.lit(""))))
        out = F.concat(out, rows) if out is not None else rows
    return out


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The input with fingerprint, layout and turns (array of role and text), in place of columns of these names."""
    record, fields = F.col(f"`{record_col}`"), unused(records, "fields")
    names = F.create_map(*[F.lit(x) for pair in known_fingerprints(layouts).items() for x in pair])
    marked = records.withColumn("fingerprint", schema_fingerprint(record)).withColumn("layout", F.when(F.col("fingerprint").isNotNull(), F.try_element_at(names, F.col("fingerprint"))))
    parsed = marked.withColumn(fields, F.from_json(record, _superset(layouts)))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col(fields), x)).otherwise(turns)
    return parsed.withColumn("turns", turns).drop(fields)


def format_turns(turned: DataFrame) -> DataFrame:
    """Adds formatted (the text in the template) and mask (length and loss of each part, three to a turn), in place of
    columns of these names."""
    safe = unused(turned, "safe")
    part = lambda c, loss: F.struct(F.length(c).alias("length"), loss.alias("loss"))
    escaped = turned.withColumn(safe, F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))))
    head = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
    formatted = F.array_join(F.transform(safe, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    mask = F.flatten(F.transform(safe, lambda t: F.array(part(head(t), F.lit(False)), part(t["text"], t["loss"]), part(F.lit(END), F.lit(False)))))
    return escaped.withColumn("formatted", formatted).withColumn("mask", mask).drop(safe)


def read_turns(formatted: Column) -> Column:
    """Array of role and text out of a formatted text."""
    written = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    halves = F.transform(written, lambda x: F.split(x, r"<\|text\|>", -1))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(h[1]).alias("text")))


#: Layouts of records that records_of makes, by the remainder of conv_id.
MIXED = ("messages", "from_value", "dialog", "prompt_response", "prompt_completion", "instruction", "question_answer")


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record): one JSON record for each conv_id, turns in the order of turn, role and text (null turns last).

    Records come in the layout of MIXED that the remainder of conv_id by their number says, as a corpus from many
    sources would: the prompt layouts take a user's turn and an assistant's and nothing else, and layouts that rename
    roles take none of the names they rename. What a layout can't take, and a null conv_id, comes as messages."""
    turn = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    names = {a: b for b, a in reversed(ALIASES)}  # the first alias of each canonical role
    renamed = lambda c: F.coalesce(*[F.when(c == a, F.lit(b)) for a, b in names.items()], c)
    free = ~F.exists("rows", lambda x: x["role"].isin([a for a, _ in ALIASES]))
    pair = (F.size("rows") == 2) & (F.get("rows", F.lit(0))["role"] == "user") & (F.get("rows", F.lit(1))["role"] == "assistant")
    turns = lambda role, text, name: F.transform("rows", lambda x: F.struct(name(x["role"]).alias(role), x["content"].alias(text)))
    record = F.to_json(F.struct(turns("role", "content", lambda c: c).alias("messages")))
    for n, layout in enumerate(x for name in MIXED[1:] for x in LAYOUTS if x.name == name):
        if layout.listed:
            key, role, text = layout.listed
            made, fits = F.struct(turns(role, text, renamed).alias(key)), free
        else:
            keys = {role: keys[-1] for role, keys in layout.fixed if role in ("user", "assistant")}
            keys["user"] = next(k[0] if layout.name == "instruction" else k[-1] for r, k in layout.fixed if r == "user")
            made, fits = F.struct(F.get("rows", F.lit(0))["content"].alias(keys["user"]), F.get("rows", F.lit(1))["content"].alias(keys["assistant"])), pair
        record = F.when((F.pmod("conv_id", F.lit(len(MIXED))) == n + 1) & fits, F.to_json(made)).otherwise(record)
    return listed.select("conv_id", record.alias("record"))


def op9_chat_format(conversations: DataFrame) -> DataFrame:
    spark: SparkSession = conversations.sparkSession
    said = "'</s>[INST] ok [/INST]'"
    added = spark.sql(f"select cast(-7 as bigint) conv_id, cast(turn as bigint) turn, role, {said} text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(added)
    done = format_turns(canonical_turns(records_of(rows))).select("conv_id", "formatted", "mask").withColumn("read", read_turns(F.col("formatted")))
    said_in_turn = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    counted = done.withColumn("loss", F.array_join(F.transform("read", lambda t, i: F.when(F.element_at("mask", (3 * i + 2).cast("int"))["loss"], t["text"]).otherwise(F.lit(""))), ""))
    return counted.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said_in_turn, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS t
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(r) + length(t) + 23) AS bigint) AS formatted_chars
FROM made GROUP BY conv_id
"""
