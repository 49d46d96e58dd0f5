"""Awkward tables for every operator: repeated rows, ties, null and extreme ids, clashing names, no rows; and whole brute force."""

import bisect
import collections
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat_format, fingerprints, jaccard_join, lattice_lm, licences, mixing, packing, page_text, quality_rules, suffix_dedup

DOCS = "doc_id long, text string, source string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_text = " ".join(f"word{i} of" for i in range(70)) + "."
ROWS = [
    (5, _text, "a"), (5, _text, "a"), (5, "another text of five", "b"), (None, _text, "a"), (None, None, None), (None, "", "a"),
    (HIGH - 1, "so high it is", "b"), (LOW, _text + " More.", None), (0, " ", "a"), (7, "x", ""), (7, "x", ""), (8, "日本語 text\n\n" * 30, "b"),
    (9, "y" * 70_000, "a"), (10, "z " * 9_000, "b"),
]
#: Names that the operators use inside.
CLASHES = (
    "chunk bucket range to key tie h n n_chars times taken taken_id size seat shard block source_size target start length offset digest license words "
    "root component_id label print next edited guest url html path host id page_id held_out numbers counts spelled verdict q lexicon_bits bits slice at a.b"
).split()
OPERATORS = {
    "op1": packing.pack,
    "op3": suffix_dedup.removal_report,
    "op3 texts": suffix_dedup.without_repeats,
    "op4": lattice_lm.score_documents,
    "op5": fingerprints.edit_report,
    "op5 prints": fingerprints.fingerprints,
    "op7": lambda d: mixing.mix(d).documents,
    "op7 texts": mixing.repeat_documents,
    "op8": jaccard_join.similar_groups,
    "op8 texts": jaccard_join.one_of_each,
    "op9": licences.scan,
    "op10": quality_rules.quality_report,
    "op10 texts": quality_rules.clean_documents,
}
#: One row for each row of the table (the texts of op3 that lose all their bytes go).
ROW_BY_ROW = {"op3", "op4", "op5", "op5 prints", "op7", "op8", "op9", "op10"}


def plain(frame, columns):
    rounded = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return collections.Counter(tuple(rounded(r[c]) for c in columns) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    """The same rows whatever other columns there are; equal rows alike; every row answered; none from none."""
    run = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    made = run(docs)
    columns = [c for c in made.columns if c not in ("sequence_id", "offset")]
    got = plain(made, columns)
    if name in ROW_BY_ROW:
        by_id = collections.Counter(i for i, _, _ in ROWS)
        at = columns.index("doc_id")
        answered = collections.Counter()
        for r, k in got.items():
            answered[r[at]] += k
        assert answered == by_id
    clashing = docs.select("*", *[F.lit(f"{c} of others").alias(c) for c in CLASHES if c not in docs.columns])
    again = run(clashing)
    if name.endswith("texts"):
        assert again.columns == clashing.columns
        columns = [c for c in columns if c in docs.columns]
        got = plain(made, columns)
    assert plain(again, columns) == got
    assert run(spark.createDataFrame([], DOCS)).count() == 0
    assert run(clashing.limit(0)).count() == 0


def test_pages_and_turns(spark):
    """Pages and conversations: repeated rows, null ids, clashing names, no rows."""
    page = "<body><p>Menu</p><article><p>{}</p></article></body>"
    rows = [(1, "http://a.example/1", page.format("One")), (1, "http://a.example/1", page.format("One")), (None, "http://a.example/2", page.format("Two"))]
    rows += [(None, None, None), (HIGH, "", ""), (LOW, "no url", page.format("Low")), (2, "http://a.example/1", page.format("x " * 50_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = plain(page_text.main_texts(pages), ["page_id", "url", "text", "n_chars"])
    want = [(1, "http://a.example/1", "One", 3)] * 2 + [(None, "http://a.example/2", "Two", 3), (None, None, "", 0), (HIGH, "", "", 0), (LOW, "no url", "Low", 3)]
    assert got == collections.Counter([*want, (2, "http://a.example/1", "x " * 49_999 + "x", 99_999)])
    clashing = pages.select("*", *[F.lit(1).alias(c) for c in CLASHES if c not in pages.columns])
    assert plain(page_text.main_texts(clashing), ["page_id", "url", "text", "n_chars"]) == got
    assert page_text.main_texts(pages.limit(0)).count() == 0
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (None, 1, "assistant", "c" * 90_000), (HIGH, LOW, "assistant", "d")]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    said = plain(chat_format.digests(chat_format.format_chats(turns)), columns)
    assert {(r[0], r[1], r[3]) for r in said} == {(1, 4, 1), (None, 1, 90_000), (HIGH, 1, 1)}
    clashing = turns.select("*", *[F.lit(1).alias(c) for c in (*CLASHES, "p", "s", "t", "ts", "turns", "stretch", "formatted", "mask")])
    assert plain(chat_format.digests(chat_format.format_chats(clashing)), columns) == said
    assert chat_format.digests(chat_format.format_chats(turns.limit(0))).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of some values, signed."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            raw = x.encode() if isinstance(x, str) else struct.pack("<q", x) if not isinstance(x, np.int32) else struct.pack("<i", x)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def prints_by_force(texts, band, more=()):
    """Fingerprints of texts, and of more texts by the same lexicon, from document frequencies over the texts."""
    words = lambda t: {(spark_hash(w) & (1 << 64) - 1) >> 64 - fingerprints.TERM_BITS for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())}
    df = collections.Counter(n for t in texts for n in words(t))
    lexicon = {n for n, k in df.items() if band.least <= k <= max(band.least, band.most_share * len(texts))}

    def one(text):
        keys, out = sorted(spark_hash(np.int32(n)) for n in words(text) & lexicon), []
        for i in range(fingerprints.SUBSETS):
            inside = [k for k in keys if (k >> 4 * i) & ((1 << fingerprints.DENSITIES[i // 4]) - 1) == 0]
            out.append(spark_hash(np.int32(i), inside) if inside else 0)
        return out if any(out) else [spark_hash(np.int32(-1 - i), text) for i in range(fingerprints.SUBSETS)]

    return [one(t) for t in [*texts, *more]]


def test_fingerprints_by_force(spark):
    """Fingerprints and both likenesses of texts and their edits."""
    rng = np.random.default_rng(4)
    zipf = lambda n: " ".join(f"w{int(x) % 900}" for x in rng.zipf(1.3, n))
    texts = [zipf(int(rng.integers(0, 400))) for _ in range(40)]
    texts += [texts[3], texts[5] + " tail", texts[7].upper(), "é梦 " + texts[8]]
    rows = list(enumerate(texts))
    band = fingerprints.Band(2, 0.3)
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    every = prints_by_force(texts, band, edited)
    own, of_edited = every[: len(texts)], every[len(texts) :]

    def alike(a, b):
        judged = [x == y for x, y in zip(a, b) if x or y]
        return sum(judged) / len(judged) if judged else 0.0

    as_text = lambda p: "-".join(f"{h & (1 << 64) - 1:016x}" for h in p)
    got = {r.doc_id: r for r in fingerprints.edit_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), band).collect()}
    for i, _ in rows:
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (as_text(own[i]), as_text(of_edited[i])), i
        assert abs(got[i].near_edited - alike(own[i], of_edited[i])) < 1e-9
        assert abs(got[i].near_next - alike(own[i], own[(i + 1) % len(rows)])) < 1e-9
    assert len({g.fingerprint for g in got.values()}) > 30 and any(0 < g.near_edited < 1 for g in got.values())


def test_pages_by_force(spark, monkeypatch):
    """Unmarked pages of random templates: what is left is what the nearest page hasn't, in ranges of any size."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        host = int(rng.integers(6))
        lines = [f"t{host} {k}" for k in range(12) if rng.random() < 0.7]
        for k in range(int(rng.integers(1, 5))):
            lines.insert(int(rng.integers(0, len(lines) + 1)), f"own {i} {k}")
        path = "/".join(str(int(x)) for x in rng.integers(0, 4, 3))
        rows.append((i, f"http://h{host}.example/{path}", lines))
    pages = {i: (u, lines) for i, u, lines in rows}
    want = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        order = sorted(("/" + u.split("/", 3)[3], i) for i, u, _ in rows if u.split("/")[2] == host)
        for path, i in order:
            k = bisect.bisect_left(order, (path, i))
            beside = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            same = lambda a: next((n for n, (x, y) in enumerate(zip(a[0], path)) if x != y), min(len(a[0]), len(path)))  # noqa: B023, E731
            near = max(beside, key=same)
            want[i] = "\n".join(x for x in pages[i][1] if x not in pages[near[1]][1])
    html = [(i, u, "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>") for i, u, lines in rows]
    frame = spark.createDataFrame(html, "page_id long, url string, html string").repartition(5)
    for n, ranges in ((1000, 8192), (4, 8192), (1, 5)):
        monkeypatch.setattr(page_text, "RANGES", ranges)
        assert {r.page_id: r.text for r in page_text.main_texts(frame, rows=n).collect()} == want, n
