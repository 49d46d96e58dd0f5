"""Quality rules, line first (operator 10, DataFrame expressions only).

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document goes if too much of its text went with them. Base
figures that need no verdict on lines are computed beside it.

Defined results
* null text: no words, every figure 0, ``base_failed`` true
* empty text: the same
* blank lines are never judged and stay
* repeated rows and ties: each row is judged by itself; no row depends on another
* empty table: no rows
* very long texts: one row's arrays grow with that row alone; three-word windows
  are compared by 64-bit hashes that are sorted, so the time is n log n
* extra columns pass through ``clean_documents`` whatever their names are

Everything is a projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

#: Phrases of page furniture, looked for in lower-cased short lines.
FURNITURE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "accept cookies",
    "click here",
    "read more",
    "sign in",
    "log in",
    "sign up",
    "subscribe to",
    "share this",
    "follow us",
    "skip to content",
    "back to top",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "add to cart",
)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LineRules:
    """Thresholds; the defaults are the production values."""

    symbols: str = "#*$%&|<>{}"
    symbols_per_word: float = 0.5
    marks_per_word: float = 0.5
    separators: str = "|»·•"
    words_per_item: float = 3.0
    least_separators: int = 2
    run_on_words: int = 100
    furniture: tuple[str, ...] = FURNITURE
    furniture_words: int = 20
    most_lost: float = 0.5


def _line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line that has a word breaks a rule; its words are counted by its spaces where these are single."""

    def judged(n: Column) -> Column:
        punctuation = (
            (native.count_of(line, rules.symbols) > n * rules.symbols_per_word)
            | ((n > 3) & (native.count_of(line, "!?") > n * rules.marks_per_word))
            | ((n >= rules.run_on_words) & (native.count_of(line, ".!?,;:") == 0))
        )
        navigation = native.let(
            native.count_of(line, rules.separators),
            lambda bars: (bars >= rules.least_separators) & (n - bars <= (bars + 1) * rules.words_per_item),
        )
        furniture = native.let(F.lower(line), lambda x: _has_any(x, rules.furniture))
        return punctuation | navigation | ((n <= rules.furniture_words) & furniture)

    other = _has_any(line, ("  ", "\t", "\x0b", "\x0c", "\r"))
    n = F.when(other, F.size(native.words(line)).cast("long")).otherwise(native.count_of(F.btrim(line), " ") + 1)
    return native.let(n, judged)


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = text.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | text.contains(phrase)
    return found


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that an array of words holds twice or more."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def twice(h: Column) -> Column:
        """Hashes that occur again, each once or more."""
        return native.let(F.sort_array(h), lambda s: F.filter(s, lambda x, j: F.get(s, j + 1) == x))

    def places(h: Column, again: Column) -> Column:
        """Where windows stand that occur again: a short list is searched, a long one sorted together."""
        searched = F.transform(F.filter(_indexed(h), lambda e: F.array_contains(again, e["h"])), lambda e: e["i"])
        together = F.sort_array(_indexed(h))
        sorted_ = native.let(
            together,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda e, j: F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        return F.when(F.size(again) <= 32, searched).otherwise(sorted_)

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((a["n"] + (i + 3) - F.greatest(i, a["end"])).cast("long").alias("n"), (i + 3).alias("end")),
            lambda a: a["n"],
        )

    def count(h: Column) -> Column:
        return native.let(
            twice(h), lambda again: F.when(F.size(again) == 0, F.lit(0).cast("long")).otherwise(covered(places(h, again)))
        )

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(native.let(hashes, count))


def _indexed(h: Column) -> Column:
    return F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))


def judge(text: Column, rules: LineRules = LineRules()) -> Column:
    """A struct of the base figures, the verdict and the cleaned text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    solid = native.without(whole, native.BLANKS)
    with_word = F.filter(lines, lambda x: F.btrim(x, F.lit(native.BLANKS)) != "")
    dup_lines = native.let(with_word, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    good = F.filter(lines, lambda x: (F.btrim(x, F.lit(native.BLANKS)) == "") | ~_line_fails(x, rules))

    def verdict(s: Column) -> Column:
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        left = F.length(native.without(s["clean"], native.BLANKS)).cast("long")
        return native.let(
            left,
            lambda kept_chars: F.struct(
                *[s[c].alias(c) for c in (*FIGURES, "clean")],
                kept_chars.alias("kept_chars"),
                failed.alias("base_failed"),
                (~failed & (s["word_chars"] - kept_chars <= s["word_chars"] * rules.most_lost)).alias("kept"),
            ),
        )

    counts = native.let(
        native.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again"))
    )

    def figures(c: Column) -> Column:
        return F.struct(
            c["n"].alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            native.count_of(whole, "#*$%&|<>").alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            c["again"].alias("n_repeat_words"),
            F.array_join(good, "\n").alias("clean"),
        )

    return native.let(native.let(counts, figures), verdict)


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: ``doc_id``, the base figures, ``base_failed`` and ``kept``."""
    q = docs.select("doc_id", judge(F.col("text"), rules).alias("q"))
    return q.select(
        "doc_id",
        *[F.col(f"q.{c}").alias(c) for c in (*FIGURES, "base_failed", "kept", "kept_chars")],
    )


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents with failing lines removed; ``n_chars`` follows the text where it exists."""
    q = native.fresh(docs, "verdict")
    # a generator, as a filter over the column would be pushed below it and judge every text twice
    judged = docs.withColumn(q, F.explode(F.filter(F.array(judge(F.col("text"), rules)), lambda x: x["kept"])))
    new = {"text": F.col(q)["clean"], "n_chars": F.length(F.col(q)["clean"]).cast("long")}
    return judged.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])
