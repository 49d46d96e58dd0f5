"""Every operator against a brute-force version on small tables with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, fingerprints, induced_sort, jaccard_join, lattice_lm, licences, mixing, packing, page_text, quality_rules, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string"
_long = " ".join(f"w{i % 977} é{i}" for i in range(6000))
_base = " ".join(f"tok{i}" for i in range(80))
ROWS = [
    (1, _base, "a"), (2, _base, "a"), (3, _base + " tail", None), (4, _base.upper() + " Tail end", "b"), (5, None, "b"), (6, "", None),
    (7, "one two", "a"), (8, "one two", "c"), (9, _long, "a"), (10, "Ünïcode ßtraße it's 12 ½ " * 9, "b"), (11, "a\nb\na\n\n| x | y |\n" * 8, "c"),
    (12, " \t\x0b", "a"), (13, "x " * 300, "b"), (14, "梦 " + _base[100:400], "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    marked = [(90, "a <|startoftext|> b<|endoftext|>"), (91, "a <| b |> it <|x|>"), (92, "<|endoftext|>" * 4100)]
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*((i, t) for i, t, _ in ROWS), *marked]}
    assert 49406 in ids[90] and 49407 in ids[90]
    docs = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(marked, "doc_id long, text string"))
    rows = packing.pack(docs, shard_pieces=4).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(np.array(part, "<u4").tobytes()), len(ids[r.doc_id]))
    for i, ps in pieces.items():
        assert [s for s, _ in sorted(ps)] == [0, *np.cumsum([n for _, n in sorted(ps)])[:-1]] and sum(n for _, n in ps) == len(ids[i])
    for ps in sequences.values():
        assert [o for o, _ in sorted(ps)] == [0, *np.cumsum([n for _, n in sorted(ps)])[:-1]] and sum(n for _, n in ps) <= 4096
    assert len(pieces) == len(ROWS) + 3 and packing.pack(none).count() == 0


def test_best_fit_equals_a_plain_search():
    lengths = np.sort(np.random.default_rng(0).integers(1, 101, 400))[::-1]
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    room = {}
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        fits = [r for r in room.values() if r >= n]
        assert (room.get(s, 100) == min(fits)) if fits else s not in room
        assert o == 100 - room.get(s, 100)
        room[s] = room.get(s, 100) - n


def test_quality_rules(docs, none):
    for r in quality_rules.quality_report(docs).collect():
        text = dict((i, t) for i, t, _ in ROWS)[r.doc_id] or ""
        w = WORDS.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often, again = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            again |= {i, i + 1, i + 2} if often[g] > 1 else set()
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_rules.clean_documents(docs)
    assert kept.columns == docs.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert quality_rules.quality_report(none).count() == 0


def test_sorted_suffixes(monkeypatch):
    """Any text, with a few bytes of memory, few names as symbols and short blocks: order and common prefixes as far as the limit."""
    rng = np.random.default_rng(3)
    for k in range(150):
        n = int(rng.integers(1, 150))
        text = np.append(rng.integers(2, int(rng.integers(3, 7)), n), 1).astype(np.uint32)
        text = np.append(np.tile(text[:-1], 3), np.uint32(1)) if k % 5 == 0 else text
        monkeypatch.setattr(induced_sort, "BLOCK", int(rng.choice([4, 16, 1 << 14])))
        monkeypatch.setattr(induced_sort, "NAMES", int(rng.choice([3, 4096])))
        limit = int(rng.integers(3, 60))
        got = list(induced_sort.sorted_suffixes(induced_sort.text_file([text], 8), 8, limit, int(rng.choice([64, 3000, 1 << 20]))))
        pos, lcp = (np.concatenate(x).tolist() for x in zip(*got))
        cut = [tuple(text[i : i + limit].tolist()) for i in pos]
        assert sorted(pos) == list(range(len(text))) and cut == sorted(cut, reverse=True)
        for a, b, same in zip(cut, cut[1:], lcp[1:]):
            assert same == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed_by_force(rows):
    """Per id and text: bytes, removed bytes, runs, and the digest of the rest; null ids come last."""
    first = {}
    rank = lambda i: (1 << 63) - 1 if i is None else i
    texts = sorted(((rank(i), (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, b in texts:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, none):
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(docs).collect())
    assert got == removed_by_force([(i, t) for i, t, _ in ROWS])
    assert suffix_dedup.removal_report(none).count() == 0
    kept = suffix_dedup.without_repeats(docs.withColumn("cut", F.lit(1)))
    assert kept.columns == [*docs.columns, "cut"]


def test_suffix_dedup_passages(spark):
    """A line of all documents, near copies, repeated rows, null ids, with a few KB of memory and many chunks."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 102, int(rng.integers(1, 6)))))
    line, base = " ".join(word() for _ in range(40)), [word() for _ in range(200)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(int(rng.integers(5, 90)))]
        own[3:3] = [line] * (1 + i % 2)
        if i % 3 == 0:
            own = list(base)
            own[int(rng.integers(200))] = word()
            own[int(rng.integers(200))] = "é梦"
        rows.append((None if i % 29 == 28 else 100 - i, " ".join(own)))
    rows += [rows[4], rows[9], (7, rows[12][1]), (3, "ab" * 200), (4, "ab" * 150 + "a" * 120), (None, rows[5][1])]
    want = removed_by_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"chunk_bytes": 1500, "stretch_bytes": 4000, "memory": 2000}):
        got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, *r[1:]) for r in suffix_dedup.removal_report(docs, **options).collect())
        assert got == want


def test_suffix_dedup_sorts_what_may_repeat(monkeypatch):
    """Around a passage of many documents stretches differ: only the parts that another stretch may have are sorted, and results stay."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = letters(300)
    texts = [letters(150) + passage[int(rng.integers(3)) : 290 + int(rng.integers(10))] + letters(150) for _ in range(120)]
    texts += [texts[5][:200] + "\0\0" + texts[5][200:], texts[6][:201] + "x" + texts[6][202:], "ab" * 70, "ab" * 60 + "\0" * 60, "\0" * 70]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    want = {i: removed for i, _, removed, *_ in removed_by_force(rows)}
    solve, sent = suffix_dedup.least_owners, []
    monkeypatch.setattr(suffix_dedup, "least_owners", lambda raw, start, n, *more: (sent.append(int(n.sum())), solve(raw, start, n, *more))[1])
    sorted_bytes = []
    for most, block in ((1 << 19, 1 << 14), (50, 7), (1, 3)):
        monkeypatch.setattr(suffix_dedup, "SHARED_ROWS", most)
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        sent.clear()
        chunks = [pa.table({"chunk": pa.array([c] * len(r), pa.int32()), "doc_id": [i for i, _ in r], "tie": [0] * len(r), "text": [t for _, t in r]}) for c, r in enumerate((rows[::2], rows[1::2]))]
        grams = pa.concat_tables(suffix_dedup._grams(t, 3) for t in chunks)
        pick = lambda t, c, k: t.filter(pa.compute.equal(t.column(c), k))
        reports = pa.concat_tables(suffix_dedup._reported(pick(grams, "bucket", k)) for k in range(3) if pick(grams, "bucket", k).num_rows)
        out = [suffix_dedup._stretches(t, pick(reports, "chunk", c), 3, 2) for c, t in enumerate(chunks)]
        dealt = pa.concat_tables(out).select(["chunk", "bucket", "grams", "lengths", "least", "bytes"]).sort_by("bucket")
        answers = pa.Table.from_batches(suffix_dedup._solve(dealt.filter(pa.compute.greater_equal(dealt.column("bucket"), 0)).combine_chunks().to_batches(), 3000))
        got = dict.fromkeys(want, 0)
        for c, t in enumerate(out):
            for r in suffix_dedup._spans(pick(t, "bucket", -1), pick(answers, "chunk", c)).to_pylist():
                spans = np.frombuffer(r["spans"], "<i8").reshape(-1, 2)
                got[r["doc_id"]] = int((spans[:, 1] - spans[:, 0]).sum())
        assert got == want
        sorted_bytes.append(sum(sent))
    assert 0 < sorted_bytes[0] < sorted_bytes[2] / 5


def test_suffix_dedup_cuts_large_groups():
    """A gram of very many stretches: each keeps only what another may have, found in little memory."""
    rng = np.random.default_rng(6)
    m, reach = (1 << 18) + 999, suffix_dedup.WINDOW - suffix_dedup.GRAM
    n, place = rng.integers(suffix_dedup.WINDOW, 85, m), np.full(m, reach)
    text = rng.integers(97, 101, (m, 84), np.uint8)
    text[:, reach : reach + suffix_dedup.GRAM] = 120
    skip, size = suffix_dedup._shared(text.reshape(-1), np.zeros(m, np.int64), np.arange(m) * 84, n, place, 1 << 20)
    agreed = []
    for rows, most in ((text[:, reach - 1 :: -1], place), (text[:, reach + suffix_dedup.GRAM :], n - reach - suffix_dedup.GRAM)):
        inside = np.arange(reach) < most[:, None]
        texts = [bytes(r) for r in np.where(inside, rows, 0)]
        order = sorted(range(m), key=texts.__getitem__)
        with_next = [0, *(next((k for k in range(reach) if texts[a][k] != texts[b][k]), reach) for a, b in zip(order, order[1:])), 0]
        agreed.append(np.zeros(m, np.int64))
        agreed[-1][order] = np.maximum(with_next[1:], with_next[:-1])
        agreed[-1] = np.minimum(agreed[-1], most)
    assert (skip == reach - agreed[0]).all() and (size == agreed[0] + suffix_dedup.GRAM + agreed[1]).all()
    assert size.sum() < n.sum() * 0.7


def test_jaccard_join(docs, none):
    sets = {}
    for i, t, _ in ROWS:
        w = lower(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard_join.similar_groups(none).count() == 0


def test_null_ids(spark):
    """Rows without an id are documents by their texts: in groups, and through every stage of the pipeline."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    near, other = [f"{word()} the" for _ in range(60)], " ".join(f"{word()} and" for _ in range(60)) + "."
    near = " ".join(near) + "."
    rows = [(1, near, "a"), (None, near + " tail", "a"), (None, other, "a"), (None, other, "a"), (None, None, "b"), (None, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard_join.similar_groups(docs).collect()
    assert sorted((r.doc_id is None, r.component_id == 1, r.n_shingles > 0) for r in got) == sorted([(False, True, True), (True, True, True), *[(True, False, True)] * 2, *[(True, False, False)] * 2])
    assert len({r.component_id for r in got if r.component_id != 1 and r.n_shingles}) == 1
    kept = jaccard_join.one_of_each(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, near), (0, other), (0, other), (0, ""), (0, "")])
    taken = collections.Counter((r.doc_id, r.text) for r in mixing.repeat_documents(docs).collect())
    want = collections.Counter()
    for r in mixing.mix(docs).documents.collect():
        want[r.doc_id is None] += r.taken
    assert taken[None, other] and set(taken) <= {(1, near), (None, near + " tail"), (None, other)}
    assert abs(sum(n * len(t.split()) for (i, t), n in taken.items()) - sum(want.values())) <= 240
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert {r.doc_id for r in out.collect()} == {1, None}


def test_jaccard_repeated_ids(spark):
    """An id with two texts links to what either links to."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (3, b + " tail"), (4, "other words are here now")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_jaccard_chains(spark):
    """Links that only chains of near copies give, with lists in several groups."""
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        w = [f"g{g}x{k}" for k in range(60)]
        for k in range(12):
            rows.append((len(rows), " ".join(w)))
            w[int(rng.integers(60))] = f"n{g}y{k}"
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(12):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_jaccard_common_passage(spark):
    """A passage that many documents share, as every share of them: only the sets that reach the threshold link."""
    rng, rows = np.random.default_rng(7), []
    passage = [f"p{k}" for k in range(50)]
    for i in range(150):
        own = [f"d{i}w{k}" for k in range(int(rng.integers(0, 30)))]
        cut = int(rng.integers(0, len(own) + 1))
        rows.append((i, " ".join([*own[:cut], *passage[int(rng.integers(0, 4)) :], *own[cut:]])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            root[a] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root and 1 < len(set(root.values())) < 150


def test_sql(spark, sf):
    from oracle_check import mismatches

    from tessera.llm.queries import ORACLE_SQL, QUERIES

    assert mismatches(spark, QUERIES, ORACLE_SQL, sf) == {}


def _vocabulary():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=lattice_lm.default_vocabulary())
    usable = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
    return {m.id_to_piece(i).encode(): i for i in usable if "▁" not in m.id_to_piece(i)[1:]}


def test_lattice(docs, none):
    grid = lattice_lm.lattice(lattice_lm.default_vocabulary())
    pieces = _vocabulary()

    def spell(raw):  # every segmentation, one by one
        if not raw:
            return 1.0
        by_byte = math.exp(grid.log_p[grid.bytes[raw[0]]]) * spell(raw[1:])
        return by_byte + sum(math.exp(grid.log_p[i]) * spell(raw[len(p) :]) for p, i in pieces.items() if raw.startswith(p))

    words = ["the", "éa", "a", "ther", "梦x", "Ab"]
    want = [math.log(spell("▁".encode() + w.encode())) for w in words]
    assert np.allclose(grid.score([w.encode() for w in words]), want, rtol=1e-9)
    rows = lattice_lm.score_documents(docs).collect()
    count = collections.Counter()
    for i, t, _ in ROWS:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*lower(t), "\0end"])
    n, v = sum(count.values()), len(count)
    texts = {i: t for i, t, _ in ROWS}
    for r in rows:
        tokens = [*lower(texts[r.doc_id]), "\0end"]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and math.isfinite(r.score) and r.score < 0
        lengths = collections.Counter(tokens[:-1])
        one = dict(zip(lengths, grid.score([x.encode() for x in lengths])))
        known = sum(x != "\0end" for x in count)
        end, spelled = math.log(count["\0end"] / n), math.log(lattice_lm.DISCOUNT * known / n)
        total = {x: np.logaddexp(one[x] + spelled, math.log(max(count[x] - lattice_lm.DISCOUNT, 1e-300) / n)) for x in lengths}
        both = end + sum(k * total[x] for x, k in lengths.items())
        assert abs(both / math.log(10) - r.drawn_score) < 1e-6 * abs(r.drawn_score)
        urn, before, seen = lattice_lm.URN, math.log(1 - count["\0end"] / n), collections.Counter()
        for t, x in enumerate(tokens[:-1]):  # word by word, in the order of the text
            end += before + np.logaddexp(math.log(urn) + total[x] - before, math.log(seen[x]) if seen[x] else -math.inf) - math.log(urn + t)
            seen[x] += 1
        assert abs(end / math.log(10) - r.score) < 1e-6 * abs(r.score)
        end = math.log(count["\0end"] / n)
        assert abs((end + sum(k * one[x] for x, k in lengths.items())) / math.log(10) - r.spelled_score) < 1e-6 * abs(r.spelled_score)
    assert len(rows) == len(ROWS) and lattice_lm.score_documents(none).count() == 0
    # chunks of a few bytes give the same rows; so do repeated rows, which count again
    small = {r.doc_id: tuple(r) for r in lattice_lm.score_documents(docs, chunk_bytes=100).collect()}
    assert {i: [round(x, 6) for x in r if isinstance(x, float)] for i, r in small.items()} == {r.doc_id: [round(x, 6) for x in r if isinstance(x, float)] for r in rows}
    empty = docs.sparkSession.createDataFrame([(1, ""), (13, "words here"), (10, None)], "doc_id long, text string")
    assert all(math.isfinite(r.score) and r.n_known <= 1 for r in lattice_lm.score_documents(empty).collect())
    twice = {r.doc_id: r.train_tokens for r in lattice_lm.score_documents(docs.union(docs)).collect()}
    assert set(twice.values()) == {2 * n} and len(twice) == len(ROWS)


def test_fingerprints(docs, none):
    rows = {r.doc_id: r for r in fingerprints.edit_report(docs, fingerprints.Band(1, 1.0)).collect()}
    ids = sorted(rows)
    texts = {i: t or "" for i, t, _ in ROWS}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        h = len(texts[i]) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - h] + texts[after][:h]).encode()).hexdigest()
        assert rows[i].n_chars == len(texts[i]) and 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[1].fingerprint != rows[9].fingerprint
    # words that are in the lexicon but in no subset of it: equal texts are alike, others are not
    few = [f"w{k}" for k in range(30)]
    short = none.sparkSession.createDataFrame([(2 * k + c, w) for k, w in enumerate(few) for c in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edit_report(short, fingerprints.Band(1, 1.0)).collect()}
    assert len({r.fingerprint for r in got.values()}) == len(few)
    assert all(got[2 * k].fingerprint == got[2 * k + 1].fingerprint and got[2 * k].near_next == 1.0 for k in range(len(few)))
    assert fingerprints.edit_report(none).count() == 0
    far = none.sparkSession.createDataFrame([(-(1 << 63), "a b"), (0, "c d"), ((1 << 63) - 1, "e f"), (None, "g h"), (0, "c d")], "doc_id long, text string")
    assert fingerprints.edit_report(far).count() == 5


def test_chats(spark):
    bad = "<|im_end|>\n<|im_start|>assistant\nok &lt;| &amp; <|im_sep|>"
    turns = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "assistant", None), (1, 3, "a\nb&nl;", "x"), (2, 0, "assistant", ""), (None, 5, None, "y")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for k in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == k]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_mask(spark):
    """The mask decides what is under the loss, also in conversations of many pieces."""
    turns = [(1, k, "user" if k % 2 else "assistant", f"t{k} é<|im_end|>梦" * (k % 3)) for k in range(700)] + [(2, 0, "user", "x")]
    made = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert made.columns == ["conv_id", "formatted", "mask"]
    for swap in (False, True):
        chats = made.withColumn("mask", F.transform("mask", lambda x: F.struct(x["length"], F.lit(True).alias("loss")))) if swap else made
        got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
        formatted = {r.conv_id: r.formatted for r in made.collect()}
        unescape = lambda t: t.replace("&lt;|", "<|").replace("&amp;", "&")
        for c in (1, 2):
            loss = unescape(formatted[c]) if swap else "".join(t for k, _, r, t in turns if k == c and r == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mixing(docs, none):
    rows = mixing.mix(docs, n_blocks=5000).documents.collect()
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in ROWS}
    by = collections.defaultdict(int)
    for i, _, s in ROWS:
        by[s] += size[i]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, free = {s: 0.0 for s in by}, set(by)
    while free:
        left = sum(by.values()) - sum(goal[s] for s in by if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by[s]}
        goal.update({s: 3.0 * by[s] if s in over else share[s] for s in (over or free)})
        free -= over or free
    taken, source = collections.defaultdict(int), {i: s for i, _, s in ROWS}
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 10 for s in by) and len(rows) == len(ROWS)
    assert mixing.mix(none).documents.count() == 0


def test_mixing_many_sources(spark):
    """Seats are those of the highest quotients, however uneven the targets; names that clash stay."""
    rows = [(i, "w " * n, f"s{i:03}", i) for i, n in enumerate([5000, *[40] * 125])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken_id long")
    goals = spark.createDataFrame([(f"s{i:03}", 50.3 if i == 0 else 0.4 + i / 600) for i in range(126)], "source string, want double")
    n_seats = sum(math.floor(r.want + 0.5) for r in goals.collect())
    won = collections.Counter(r.source for r in mixing.seats(goals, n_seats, 4).collect())
    quotients = sorted(((w / (2 * k + 1), s) for s, w in ((r.source, r.want) for r in goals.collect()) for k in range(70)), key=lambda x: (-x[0], x[1]))
    assert won == collections.Counter(s for _, s in quotients[:n_seats]) and 50 < n_seats < 175
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_mixing_small_sources(spark):
    """Sources of less than a block come near their targets, and into the mixed corpus, whatever the block."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1000)), "big") for i in range(300)]
    rows += [(1000 + i, "a b c d e", s) for s, n in (("bit", 1), ("few", 12), ("low", 40), ("part", 130)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, n_blocks=100)
    taken, goal = collections.defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got.documents.collect():
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert got.block == 3010 and all(abs(taken[s] - goal[s]) <= (got.block if s == "big" else 0.02 * goal[s] + 1) for s in goal), (taken, goal)
    assert {r.source for r in mixing.repeat_documents(docs, n_blocks=100).select("source").distinct().collect()} == set(goal)


def test_pages(spark):
    page = '<html><head><title>t</title></head><body><header>Site</header><nav>m</nav><div class="cookie-notice">c</div><article><h1>A &amp; b</h1><p>One  two<br>three<p>Second <i>it</i>al.<div class="ad">Buy</div><form>go</form><section id="comments"><p>c1</p></section></article><aside>s</aside><footer>f</footer><script>"</p>"</script>'
    bare = "<body><p>Menu line</p><p>{}</p><p>Imprint</p>"
    rows = [(1, "http://h.example/a/1", page), (2, "http://x.example/b/1", bare.format("Text one")), (3, "http://x.example/b/2", bare.format("Text two")), (4, None, None)]
    got = {r.page_id: r.text for r in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {1: "A & b\nOne two three\nSecond ital.", 2: "Text one", 3: "Text two", 4: ""}
    assert page_text.shared_lines(list("abcbdab"), list("bdcaba")).__len__() == 4


def test_page_lines():
    """Signs that are no tags stay, names that hold a word of furniture beside others are none, quotes may be open."""
    lines = lambda page: [t for t, p in page_text.lines_of(page) if p != page_text.FURNITURE]
    assert lines("<p>3 < 4") == ["3 < 4"] and lines("<p>a<b") == ["a"] and lines("<p>a <br") == ["a"]
    kept = '<article><div class="share-price">42</div><section class="notice-of-law">Law</section><p data=it\'s>that\'s</p><label>L</label><math>x</math>'
    assert lines(kept) == ["42", "Law", "that's", "Lx"]
    gone = '<article><div class="share-buttons">s</div><div class="x cookie-notice">c</div><div id="comments_area">d</div><div class="main-nav">n</div><p>T'
    assert lines(gone) == ["T"]


def test_pages_copies_and_ranges(spark):
    """Copies keep their text, ranges of any size give the same rows, and the difference decides outside the article."""
    bare = "<body><p>Menu line</p><p>{}</p><p>Imprint</p>"
    marked = "<body><p>Menu line</p><h1>Head {0}</h1><article><p>Menu line</p><p>Body {0}</p></article><nav>Nav {0}</nav>"
    rows = [(i, f"http://x.example/b/{i:02}", bare.format(f"Text {i}")) for i in range(9)]
    rows += [(8, "http://x.example/b/08", rows[8][2]), (20, "http://x.example/b/04?print", rows[4][2]), (21, "http://x.example/b/04a", rows[4][2])]
    rows += [(30, "http://y.example/1", bare.format("Y one")), (31, "http://y.example/2", bare.format("Y two"))]
    rows += [(40 + i, f"http://z.example/{i}", marked.format(i)) for i in range(3)]
    rows += [(50 + i, f"http://c.example/{i}", bare.format("Copy")) for i in range(5)] + [(60, "http://c.example/9", bare.format("Other"))]
    want = {**{i: f"Text {i}" for i in range(9)}, 20: "Text 4", 21: "Text 4", 30: "Y one", 31: "Y two"}
    want |= {40 + i: f"Head {i}\nMenu line\nBody {i}" for i in range(3)} | {50 + i: "Copy" for i in range(5)} | {60: "Other"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for n in (1, 2, 1000):
        got = page_text.main_texts(pages, rows=n).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want, n


def test_licence_spellings(spark):
    rows = [(1, " licence licence per cent per  cent whilst"), (2, "License. LICENSE; percent percent - while")]
    a, b = (r[0] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(licences.canonical(F.col("t"))).collect())
    assert a == b == "license license percent percent while"


def test_licences(spark):
    mit = dict(licences.KNOWN[:1])["MIT"]
    rows = [(1, "Copyright (c) 2024 Some One\n\n" + mit.replace("sublicense", "SUBLICENCE").replace(",", " ;")), (2, mit + " more"), (3, None), (4, "released under the MIT licence")]
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: "MIT"}


def test_whole_licences(spark):
    """Published texts, long and short, with and without titles."""
    texts = {x.stem: x.read_text() for x in licences._FOLDER.glob("*.txt")}
    assert {"Apache-2.0", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    mit, isc, bsd = (next(x for n, x in licences._SHORT if n == name) for name in ("MIT", "ISC", "BSD-3-Clause"))
    body = mit.split("\n\n", 1)[1]
    apache = texts["Apache-2.0"]
    cases = [*texts.items(), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + body), ("MIT", body), ("ISC", "Copyright 2020 A\n\n" + isc.split("\n\n", 1)[1])]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + bsd), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd)]
    cases += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 A B")), ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache.replace("http://", "https://"))]
    cases += [("GPL-3.0-only", texts["GPL-3.0-only"].split("How to Apply These")[0]), (None, apache[:5000]), (None, apache + " more")]
    rows = [(i, t) for i, (_, t) in enumerate(cases)]
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}
    known = licences.known_digests(spark).distinct()
    assert known.count() == known.select("digest").distinct().count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.length <= 4096 for r in rows)
