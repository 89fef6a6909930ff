"""Chat formatting with typed content parts, in SQL functions only.

A turn is a role and an array of content parts: struct<type, text, ref, size>. A visitor flattens the
parts in order: a text part becomes its escaped text, an image, audio or document part a
placeholder <|type n|>, numbered through the conversation. Each attachment is recorded with its
number, type, reference and the number of tokens its placeholder expands to.

Template: <turn ROLE>CONTENT</turn> and a line feed for each turn. In roles and texts a backslash is
written \\s, < is \\l and > is \\g, so no control string can stand in a text and the output can be read
back exactly. The loss mask is a list of (start, length) in code points of the output: the
content of each assistant turn.

Turns come in the order of (turn, role, text), nulls first. A conversation is put together in
one row, as it has to be to be one training text; its turns are the only rows that meet.

Defined cases: null texts and roles are empty; repeated rows are repeated turns; an unknown part type is
taken as a document; a null part is left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that a placeholder expands to, by type, of parts of a given size: pixels of an image, milliseconds of audio, bytes of a document. (Fixed values.)
TOKENS = {"image": (85, 262_144, 170), "audio": (0, 20, 1), "document": (0, 4, 1)}
PART = "struct<type: string, text: string, ref: string, size: bigint>"
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def plain(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The parts of a turn that is only a text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", *TOKENS), part["type"]).otherwise(F.lit("document"))


def tokens(part: Column) -> Column:
    """Expanded tokens of an attachment: a base and some for each begun unit of its size."""
    size = F.coalesce(part["size"], F.lit(0))
    out = F.lit(0).cast("long")
    for name, (base, unit, each) in TOKENS.items():
        out = F.when(_kind(part) == name, F.lit(base) + F.ceil(size / unit) * each).otherwise(out)
    return out.cast("long")


def visit(parts: Column, done: Column) -> Column:
    """struct<content, n> of a turn's parts; attachments are numbered from done + 1."""
    start = F.struct(F.lit("").alias("content"), done.cast("long").alias("n"))

    def step(state: Column, part: Column) -> Column:
        is_text = _kind(part) == "text"
        mark = F.concat(F.lit("<|"), _kind(part), F.lit(" "), (state["n"] + 1).cast("string"), F.lit("|>"))
        return F.struct(
            F.concat(state["content"], F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark)).alias("content"),
            (state["n"] + F.when(is_text, 0).otherwise(1)).cast("long").alias("n"),
        )

    return F.aggregate(parts, start, step)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans), attachments of each conversation of rows (conv_id, turn, role, parts)."""
    key = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
        ).alias("t"),
    )
    # rows are ordered as (turn, role, texts); array_sort would compare whole structs as well
    whole = key.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    files = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: _kind(p) != "text")
    whole = whole.withColumn("files", files)
    before = lambda i: F.size(F.filter(F.flatten(F.transform(F.slice("turns", 1, i), lambda t: t["parts"])), lambda p: _kind(p) != "text"))
    done = F.when(F.size("files") == 0, F.lit(0))
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">")).alias("head"),
            visit(t["parts"], done.otherwise(before(i)))["content"].alias("content"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    whole = whole.withColumn("pieces", pieces)
    lengths = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["content"]).cast("long").alias("content"), p["learn"].alias("learn")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["head"]
        span = F.array(F.struct(begin.alias("start"), p["content"].alias("length")))
        none = F.array().cast("array<struct<start: bigint, length: bigint>>")
        return F.struct((begin + p["content"] + F.lit(len(END))).alias("at"), F.concat(state["spans"], F.when(p["learn"], span).otherwise(none)).alias("spans"))

    records = F.transform("files", lambda p, i: F.struct((i + 1).cast("long").alias("number"), _kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate(lengths, zero, step)["spans"].alias("loss"),
        records.alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of an output: cut at the turns' ends, and each at the end of its head."""
    turns = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            plain(F.substr(x, F.lit(len("<turn ") + 1), F.instr(x, ">") - F.lit(len("<turn ") + 1))).alias("role"),
            plain(F.substr(x, F.instr(x, ">") + 1)).alias("text"),
        ),
    )


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(loss, lambda s: plain(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and digests read back from the output, for rows (conv_id, turn, role, text)."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), text_part(F.col("text").cast("string")).alias("parts"))
    out = format_turns(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests in DuckDB, from the rows themselves.
ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made as (
  select *, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') as r, replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') as t from rows),
whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as learned,
    string_agg('<turn ' || r || '>' || t || '</turn>' || chr(10), '' order by turn nulls first, role, text) as formatted
  from made group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, length(formatted) as formatted_chars from whole
"""
