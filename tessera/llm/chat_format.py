"""Chat formatting by relational operations (operator 6, DataFrame expressions only).

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged by array expressions, and the whole is concatenated. Control
strings inside texts are escaped, so the formatted string can be read back.

A merged block is ``<|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n``: the
separator keeps the turns that were merged apart, and it is not under the loss.

Defined results
* null text or role: empty; null turns come first
* ties in turn go by role, then text; repeated rows are turns of their own
* a null conversation id is one conversation
* extra columns are ignored; an empty table gives no rows (the query adds its own)
* large conversations are gathered in stretches of turns before they meet, so
  the final task of one reads a row per stretch; the output of a conversation is
  one string, which no plan can divide
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

START, END, APART = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
STRETCH = 256


def escape(text: Column) -> Column:
    """No ``<|`` is left, and ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def conversations_sorted(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turn structs of each conversation in order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    stretches = (
        turns.select("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch"), turn.alias("t"))
        .groupBy("conv_id", "stretch")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
    )
    whole = stretches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "ts"))).alias("s"))
    return whole.select("conv_id", F.flatten(F.transform("s", lambda s: s["ts"])).alias("turns"))


def pieces(turns: Column, trained: tuple[str, ...] = ("assistant",)) -> Column:
    """The formatted string in pieces, each with whether the loss covers it."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column, i: Column) -> Column:
        before, after = F.get(turns, i - 1)["role"], F.get(turns, i + 1)["role"]
        opens, closes = ~F.coalesce(before == t["role"], F.lit(False)), ~F.coalesce(after == t["role"], F.lit(False))
        head = F.when(opens, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(APART))
        tail = F.when(closes, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*trained)),
            piece(tail, F.lit(False)),
        )

    return F.flatten(F.transform(turns, of_turn))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: structs of role and text."""
    chunks = F.split(formatted, "<\\|im_end\\|>\n")
    whole = F.slice(chunks, F.lit(1), F.size(chunks) - 1)

    def of_block(b: Column) -> Column:
        line = F.instr(b, "\n")
        role = _unescape_role(b.substr(F.lit(len(START) + 1), line - len(START) - 1))
        texts = F.split(b.substr(line + 1, F.length(b)), "<\\|im_sep\\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(whole, of_block))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, the ``formatted`` string and its loss ``mask``: lengths of pieces, and whether they count."""
    p = conversations_sorted(turns).select("conv_id", pieces(F.col("turns")).alias("p"))
    return p.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"),
        F.transform("p", lambda x: F.struct(F.length(x["text"]).alias("length"), x["loss"].alias("loss"))).alias("mask"),
    )


def _cut(whole: Column, lengths: Column, take: Callable[[Column, Column, Column], Column]) -> Column:
    """``take(whole, start, item)`` for each item of ``lengths``, with the start (from 1) that its ``length`` gives."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
    return native.let(F.aggregate(lengths, start, step)["starts"], lambda s: F.zip_with(lengths, s, lambda x, at: take(whole, at, x)))


def under_loss(formatted: Column, mask: Column) -> Column:
    """The pieces of a formatted string that the mask lets count.

    Characters are found by a walk from the start, so the string is first cut
    into stretches of pieces, and these into pieces: long conversations take far
    less than a walk over the whole for each piece.
    """
    first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(mask) / STRETCH).cast("int") - 1))
    total = lambda m: F.aggregate(m, F.lit(0), lambda n, x: n + x["length"])
    stretch = lambda i: native.let(F.slice(mask, i * STRETCH + 1, STRETCH), lambda m: F.struct(total(m).alias("length"), m.alias("mask")))
    counted = lambda w, at, x: F.when(x["loss"], w.substr(at, x["length"]))
    pieces_of = lambda w, at, x: native.let(w.substr(at, x["length"]), lambda part: _cut(part, x["mask"], counted))
    every = F.flatten(native.let(F.transform(first, stretch), lambda s: _cut(formatted, s, pieces_of)))
    return F.filter(every, lambda x: x.isNotNull())


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them; what the loss covers, by the mask."""
    back = formatted.select("conv_id", "formatted", under_loss(F.col("formatted"), F.col("mask")).alias("loss_texts"), read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    texts = back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        said.alias("said"),
        F.array_join(F.transform("loss_texts", unescape), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
