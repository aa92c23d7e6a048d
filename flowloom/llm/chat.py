"""Chat formatting with DataFrame functions only: turns to one string with a loss mask, and back.

A conversation's turns are collected as structs and sorted by (turn, role, text), nulls first. Adjacent turns of one role are
merged into a segment ``<|start|>role<|sep|>text<|turn|>text<|end|>``; the mark between merged texts keeps them apart. Control
strings in roles and texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first sign, and
those that have backslashes there get one more, so the text comes back by taking one off.

The loss mask is a list of spans (start, length) in code points of the formatted string, one for each turn of the loss role.

Null texts and roles are empty strings. Equal rows are turns of their own. Rows with null ``conv_id`` form one conversation.
Other columns are ignored. An empty table gives an empty result. A conversation is one row of the result, so its turns meet in
one row; only that is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, TURN, END = "<|start|>", "<|sep|>", "<|turn|>", "<|end|>"
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"), -1)


def format_chat(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of ``rows(conv_id, turn, role, text)``."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))
    at = lambda i: F.element_at("turns", i.cast("int"))
    index = F.sequence(F.lit(1), F.size("turns"))
    # where a segment starts; a segment's turns are merged over its slice of the array
    told = told.withColumn("starts", F.filter(index, lambda i: (i == 1) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"])))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    told = told.withColumn("segments", F.zip_with("starts", ends, lambda a, b: F.slice("turns", a, b - a)))
    marked = lambda s: F.concat(F.lit(START), escape(s[0]["role"]), F.lit(SEP),
                                F.array_join(F.transform(s, lambda t: escape(t["text"])), TURN), F.lit(END))
    told = told.withColumn("formatted", F.array_join(F.transform("segments", marked), ""))
    # pieces between texts and the texts themselves, by length; a span starts after all pieces before it
    pieces = F.flatten(F.transform("segments", lambda s: F.transform(s, lambda t, i: F.struct(
        F.when(i == 0, F.length(escape(t["role"])) + len(START + SEP)).otherwise(len(TURN)).alias("lead"),
        F.length(escape(t["text"])).alias("length"), F.when(i == F.size(s) - 1, len(END)).otherwise(0).alias("tail"),
        (t["role"] == loss_role).alias("loss")))))
    told = told.withColumn("pieces", pieces)
    whole = lambda p: p["lead"] + p["length"] + p["tail"]
    before = lambda i: F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda n, p: n + whole(p))
    spans = F.filter(F.transform("pieces", lambda p, i: F.struct((before(i) + p["lead"]).alias("start"), p["length"], p["loss"])), lambda s: s["loss"])
    return told.select("conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    segments = F.filter(_split(formatted, END), lambda s: s != "")

    def turns(segment):
        head = F.substring_index(segment, SEP, 1)
        role = unescape(F.substr(head, F.lit(len(START) + 1)))
        body = F.substr(segment, F.length(head) + len(SEP) + 1)
        return F.transform(_split(body, TURN), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(segments, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted table says when it is read back, as counts and hashes."""
    back = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
