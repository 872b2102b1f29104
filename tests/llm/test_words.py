"""Periodic runs, collocations and byte-level BPE against brute force and the public library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantide.llm import bpe, collocation, periodic, queries, words

from twins import assert_same

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
EDGES = [(0, "Mail a.b@c.org now"), (0, "Mail a.b@c.org now"), (None, None), (None, "null id"), (1, ""), (2, None), (3, " \t\n "), (4, LONG), (5, "日本語 ünïcode 👍 <|endoftext|>"), (-7, "x"), (10, "a b " * 40), (20, "a" * 5000)]
CLASH = ("word", "row", "n", "chunk", "own", "phrase", "lang_", "f", "a", "l", "r", "score", "rank", "ids", "text_")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def empty(edges):
    return edges.filter("doc_id = 99").cache()


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


def test_words_are_the_pattern_s():
    import pyarrow as pa

    texts = ["", None, " a\tb\x0bc ", "é  日本\x1cx\x85y", "\n", "end", "A Zé"] * 3
    for part in (pa.array(texts), pa.array(texts).slice(2, 9), pa.array([], pa.string())):
        cut = words.cut(part)
        own = cut.values.cast(pa.large_string()).to_pylist()
        got = [own[a:b] for a, b in zip(cut.bounds, cut.bounds[1:])]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in part.to_pylist()]
    assert words.cut(pa.array(["AbÉ Z"]), lower=True).values.to_pylist() == ["abÉ".encode(), b"z"]


# 13 ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.ranks(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


def told(texts, library):
    out = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        out.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_bpe_query(spark, sf, docs, library):
    rows = queries.QUERIES["op13_bpe"](spark, sf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == told(zip(docs.doc_id.tolist(), docs.text), library)


def test_bpe_of_random_texts(library, vocabulary):
    rnd = random.Random(5)
    parts = ["a", "e", "t", "th", " ", "  ", "\n", "\r\n", "\t", "é", "日", "👍", "1", "23", "'s", "'ll", ".", "--", "ing", "er", "\xa0", "\x1c", "\x85", "Ж", "ð", "=", "0", "‍"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(chr(rnd.randint(97, 122)) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 2000, "=-" * 900, " " * 700, "the" * 900]
    for t, ids in zip(texts, vocabulary.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t), repr(t)
        assert vocabulary.decode(ids) == t.encode()


@pytest.mark.parametrize("seed", range(6))
def test_bpe_of_random_vocabularies(seed):
    """Merges drawn at random, against merging the least rank first, the leftmost of equals; backtracking is common here."""
    rnd = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}

    def merged(raw):
        if raw in ranks:
            return [ranks[raw]]
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    while len(ranks) < 256 + 60:
        two = rnd.choices([t for t in ranks if set(t) <= set(b"abc")], k=2)
        joined = b"".join(two)
        if len(joined) < 12 and merged(joined) == [ranks[t] for t in two]:
            ranks[joined] = len(ranks)
    own = bpe.Ranks(ranks, r"(?s).+")
    texts = ["".join(rnd.choices("abc", k=rnd.randint(1, 40))) for _ in range(1500)]
    assert [x.tolist() for x in own.encode(texts)] == [merged(t.encode()) for t in texts]


def test_bpe_forgets_and_learns_again(docs, library, vocabulary, monkeypatch):
    texts = docs.text.tolist()[:60]
    want = [library.encode_ordinary(t or "") for t in texts]
    for name, most in (("CACHE_UNITS", 50), ("CACHE_PAIRS", 20), ("CACHE_CHARS", 4), ("SEARCHED_AT_ONCE", 30), ("GATHERED_AT_ONCE", 7)):
        monkeypatch.setattr(bpe, name, most)
    for lo in range(0, 60, 20):
        got = vocabulary.encode(texts[lo : lo + 20])
        assert [x.tolist() for x in got] == want[lo : lo + 20]
        assert [vocabulary.decode(x) for x in got] == [(t or "").encode() for t in texts[lo : lo + 20]]


def test_bpe_edges(edges, empty, library):
    import public_tokenizers

    path, pattern = public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN
    rows = bpe.digests(edges, path, pattern).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == told(EDGES, library)
    assert bpe.digests(empty, path, pattern).collect() == []
    coded = bpe.encode(edges, path, pattern, to="own_ids")
    assert coded.columns == [*edges.columns, "own_ids"]
    back = bpe.decode(coded, path, pattern, ids="own_ids").select("text", "own_ids", "decoded").collect()
    assert all(r.own_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.decode(bpe.encode(empty, path, pattern, to="own_ids"), path, pattern, ids="own_ids").collect() == []
    with pytest.raises(ValueError):
        bpe.Ranks({b"a": 0, b"b": 1, b"ab": 2}, r"(?s).+").encode(["ac"])
    with pytest.raises(ValueError):
        bpe.Ranks({b"a": 0, b"b": 1, b"c": 2, b"abc": 3}, r"(?s).+")


# 11 ----------------------------------------------------------------------------------------------------------------------


def all_runs(s, least=12):
    """Every period in turn: (start, length, period) by start, then period."""
    out = []
    code = {x: k for k, x in enumerate(dict.fromkeys(s))}
    s = np.array([code[x] for x in s])
    for p in range(1, len(s) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], s[:-p] == s[p:], [0]])))
        for i, j in edges.reshape(-1, 2).tolist():
            if j - i >= p and j - i + p >= least and not any((s[i : j + p - q] == s[i + q : j + p]).all() for q in range(1, p)):
                out.append((i, j - i + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def told_runs(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
        found = all_runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        out.append((
            str(i), len(found), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4),
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds", [1, 2, 3, 6])
def test_runs_of_random_words(kinds):
    rnd = random.Random(kinds)
    for _ in range(400):
        s = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 50))]
        if rnd.random() < 0.5:
            s += s[: rnd.randint(1, 1 + len(s) // 4)] * rnd.randint(2, 5) + s[:5]
        least = rnd.choice([1, 2, 12])
        found = periodic.runs(np.array(s), least)
        assert list(zip(found.start.tolist(), found.length.tolist(), found.period.tolist())) == all_runs(s, least)
        # No run reaches outside the stretches.
        apart = periodic.stretches(np.array(s), np.zeros(len(s), np.int64))
        assert all(any(lo <= a and a + n <= hi for lo, hi in apart) for a, n, _ in all_runs(s))


@pytest.mark.parametrize("text", [[0, 1, 2, 0, 1, 2, 3], [0] * 9, [2, 1, 0], [0], [0, 1] * 6 + [1, 0] * 4])
def test_suffix_tree(text):
    tree = periodic.SuffixTree(text, max(text) + 1)
    n = len(text)
    assert [k for k in tree.order if k < n] == sorted(range(n), key=lambda k: text[k:])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    i, j = i[i != j], j[i != j]
    common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or text[a + k] != text[b + k]), 0)
    assert tree.common(i, j).tolist() == [common(a, b) for a, b in zip(i, j)]
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    for lengths, sign in zip(tree.lyndon(), (1, -1)):
        signed = [sign * x for x in text]
        assert lengths.tolist() == [max(m for m in range(1, n - k + 1) if is_lyndon(signed[k : k + m])) for k in range(n)]


def test_periodic_query(spark, sf, docs):
    rows = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in rows), key=str) == told_runs(zip(docs.doc_id.tolist(), docs.text))
    assert any(r.n_runs > 1 for r in rows) and any(r.n_runs == 0 for r in rows)


def test_periodic_edges(edges, empty):
    assert sorted(((str(r[0]), *r[1:]) for r in periodic.find(edges).collect()), key=str) == told_runs(EDGES)
    assert periodic.find(empty).collect() == [] == periodic.with_runs(empty).collect() == periodic.collapse(empty).collect()
    told = periodic.with_runs(edges, to="own_runs")
    assert told.columns == [*edges.columns, "own_runs"]
    assert {r.text: [tuple(x) for x in r.own_runs] for r in told.select("text", "own_runs").collect()}["a b " * 40] == [(0, 80, 2)]
    kept = {r.doc_id: r.text for r in periodic.collapse(edges).select("doc_id", "text").collect()}
    assert kept[10] == "a b" and kept[2] is None and kept[3] == " \t\n " and kept[4] == LONG


# 12 ----------------------------------------------------------------------------------------------------------------------


def told_phrases(rows, least, longest=5, kept=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and b == a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    told, rank = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= kept:
            told.append((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return sorted(told)


def phrases(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in collocation.collocations(docs, **options).collect())


def test_collocations_query(spark, sf):
    assert_same(queries.QUERIES["op12_collocations"](spark, sf), queries.ORACLES["op12_collocations"], sf)


@pytest.mark.parametrize("mean, bits", [(1, 26), (2, 26), (3, 15), (16, 12)])
def test_collocations_of_random_texts(spark, mean, bits):
    """Triggers at every, every second ... place; a bitmap so small that it says yes to nearly all."""
    rnd = random.Random(mean)
    names = ["a", "B", "ab", "é", "日本", "c", "d\x1c"]
    rows = []
    for _ in range(120):
        w = [rnd.choice(names) + rnd.choice([" "] * 12 + [". ", "\t", "\n", ", ", "  "]) for _ in range(rnd.randint(0, 60))]
        rows.append((rnd.choice(["x", "y", None, "und"]), "".join(w)))
    rows += rows[:40] + [("x", None), (None, ""), ("z", " .,! "), ("y", "same words here again and again " * 300)]
    assert phrases(spark, rows, least=3, mean=mean, power=bits) == told_phrases(rows, 3)
    assert phrases(spark, rows, least=3, longest=3, kept=5, mean=mean, power=bits) == told_phrases(rows, 3, 3, 5)


def test_chunks_hold_each_word_once():
    """Equal passages have equal chunks wherever they stand, and own parts one after another are the text."""
    import pyarrow as pa

    rnd = random.Random(1)
    passage = " ".join(rnd.choice("abcdefgh") for _ in range(900))
    texts = [passage, "z z z " + passage + " y", passage + ". " + passage]
    (batch,) = collocation._chunks(4)([pa.RecordBatch.from_arrays([pa.array(["x"] * 3), pa.array(texts, pa.string())], ["lang", "text"])])
    rows = [(c.split(" "), k) for c, k in zip(batch["chunk"].to_pylist(), batch["own"].to_pylist())]
    assert [w for c, k in rows for w in c[:k]] == " ".join(texts).replace(".", "").split()
    assert len({tuple(c) for c, _ in rows}) < len(rows) / 3 + 6


def test_collocations_edges(spark, edges, empty):
    docs = edges.withColumn("lang", F.when(F.col("doc_id") > 3, "l"))
    assert sorted(tuple(r) for r in collocation.collocations(docs, least=2).collect()) == told_phrases([("l" if i is not None and i > 3 else None, t) for i, t in EDGES], 2)
    assert collocation.collocations(empty.withColumn("lang", F.lit("x"))).collect() == []
    with pytest.raises(ValueError):
        collocation.collocations(docs, longest=6)


def test_scores_beyond_64_bits(spark):
    counts = [spark.createDataFrame(r, "lang string, phrase string, f long") for r in ([("x", "a", 3 * 10**12), ("x", "b", 7 * 10**12)], [("x", "a b", 10**12)])]
    row = collocation.scored(counts, spark.createDataFrame([("x", 10**15)], "lang string, n long")).collect()[0]
    assert row.score == 1000 * 10**12 * 10**15 // (21 * 10**24)
