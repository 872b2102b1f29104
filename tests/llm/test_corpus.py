"""The corpus operators against brute force, exact round trips, or held-out accuracy, and on awkward small tables."""

import base64
import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from quantide.llm import chat, decontaminate, idstore, maxent, minhash, mpegts, packing, pii, queries, simhash, tokens, toxicity, warc

from twins import assert_same

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
#: Nulls, empty and blank texts, a very long one, repeated rows, and columns named like the operators' own.
EDGES = [(0, "Mail a.b@c.org now"), (0, "Mail a.b@c.org now"), (None, None), (None, "null id"), (1, ""), (2, None), (3, " \t\n "), (4, LONG), (5, "日本語 ünïcode 👍"), (-7, "x")]
CLASH = ("word", "row", "n", "part", "print", "h", "w", "shingle", "component_id", "pii", "media", "batch", "_print", "_toxicity", "_text_hash", "_before", "_number", "rank_in_part")


def with_clashes(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def edges(spark):
    return with_clashes(spark.createDataFrame(EDGES, "doc_id long, text string"))


@pytest.fixture(scope="module")
def empty(edges):
    return edges.filter("doc_id = 99").cache()


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", ["op4_warc", "op6_preference", "op8_decontaminate"])
def test_twins(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


# 1 -----------------------------------------------------------------------------------------------------------------------


def check_scores(rows, texts):
    own = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in texts if not out(i) for w in own(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(own(t)), sum(w in c for w in own(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own(t)), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_language_model(spark, sf, docs):
    rows = queries.QUERIES["op1_lm_score"](spark, sf).collect()
    check_scores(rows, list(zip(docs.doc_id.tolist(), docs.text)))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one():
    """Class probabilities times the shares within classes, over all known words and an unseen one of each class."""
    words = [b"the", b"cat", b"sat,", b"thing", b""]
    counts = np.array([9, 4, 2, 1, 3])
    k = maxent.Classes(words[:2], np.arange(maxent.ENDINGS) % maxent.CLUSTERS, [])
    of = k.coded(words) & 63
    mass = np.bincount(of, counts, maxent.CLASSES) + 0.5 * (np.bincount(of, minlength=maxent.CLASSES) + 1)
    rng = np.random.default_rng(0)
    w = maxent.Weights(rng.normal(size=maxent.Weights().flat.size))
    h = maxent.History(k.coded(words), np.array([len(words)]))
    p = w.classes(h, maxent.PAD, maxent.PAD + len(words))[2]
    total = sum(p[c] / mass[c] * (n + 0.5) for c, n in zip(of, counts)) + (p * 0.5 / mass).sum()
    assert math.isclose(total, 1, rel_tol=1e-5)
    assert math.isclose(math.log(p[of[2]]), w.log_target(h)[2], rel_tol=1e-4)


def test_language_model_features():
    """Scores equal plain sums over features, and no feature reaches into the document before."""
    rng = np.random.default_rng(1)
    sizes = np.array([1, 30, 3])
    codes = rng.integers(0, 64, 34) | rng.integers(0, 1 << 32, 34) << 6
    w = maxent.Weights(rng.normal(size=maxent.Weights().flat.size))
    w.skip[maxent.CLASSES] = 0
    h = maxent.History(codes, sizes)
    z = w.scores(h, maxent.PAD, len(h.target))[h.at - maxent.PAD]
    alone = maxent.History(codes[31:], sizes[2:])
    at = 0
    for n in sizes:
        own = codes[at : at + n] & 63
        for t in range(n):
            bag = sum((w.skip[own[t - back]] for back in range(2, 10) if t >= back), np.zeros(64))
            k = h.at[at + t]
            assert np.allclose(z[at + t], w.bias[0] + w.word[h.word[k]] + w.pair[h.pair[k]] + bag, atol=1e-4)
        at += n
    assert (alone.word[alone.at] == h.word[h.at[31:]]).all() and (alone.pair[alone.at] == h.pair[h.at[31:]]).all()


@pytest.mark.parametrize("n", [1, 7, 400])
def test_sums_by_row(n):
    rng = np.random.default_rng(n)
    rows, values = (rng.zipf(1.5, n) % 50).astype(np.uint16), rng.normal(size=(n, 64)).astype(np.float32)
    got, sums = maxent._by_row(rows, values.copy())
    assert got.tolist() == sorted(set(rows.tolist()))
    assert all(np.allclose(x, values[rows == r].sum(0), atol=1e-4) for r, x in zip(got, sums))


def test_language_model_is_whole(monkeypatch):
    """64 classes, and pairs of endings up to four words apart, within a document only."""
    monkeypatch.setattr(maxent.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    assert maxent.CLASSES == 64
    found = [b"one", b"two", b"six", b"ten", b"red"]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([False, True]), pa.array([5, 6]), pa.array([b" ".join(found).decode(), "one held out"])], ["doc_id", "held_out", "mark", "text"])
    rows = {w: n for b in maxent._counts(maxent._units(iter([batch]))) for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist())}
    assert {w: n for w, n in rows.items() if w[:1] != b" "} == dict.fromkeys([*found, b""], 1)
    near = {divmod(int.from_bytes(w[1:], "big"), maxent.ENDINGS): n for w, n in rows.items() if w[:1] == b" "}
    e = [maxent.ending(w) for w in found]
    assert len(set(e)) == 5 and near == {(e[i], e[j]): 1 for j in range(5) for i in range(j)}


@pytest.mark.parametrize("offset", [0, 3])
def test_units_have_the_words_of_texts(monkeypatch, offset):
    """Arrow's words, numbers and endings against Python's, also of slices, nulls, blank texts and other white space."""
    monkeypatch.setattr(maxent.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(maxent, "ROWS_AT_ONCE", 4)
    texts = ["a", "b c", "d"][:offset] + [" One  TWO\t\n.,; ", None, "", " \v\f\r ", "x\x1cy\x85\u00a0\u2003 \u0130\u00c4 '", "a", "ab", "abc!", "ABCD", "two one", LONG, "end\n"]
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n)), pa.array([False] * n), pa.array(range(n)), pa.array(texts, pa.string())], ["doc_id", "held_out", "mark", "text"]).slice(offset)
    (unit,) = maxent._unit_rows(maxent._units(iter([batch])))
    want = [maxent.words(t) for t in texts[offset:]]
    assert unit.sizes.tolist() == [len(w) for w in want]
    flat = [w for found in want for w in found]
    assert np.array(unit.words.to_pylist(), object)[unit.ids].tolist() == flat and len(set(flat)) == len(unit.words)
    assert unit.endings[unit.ids].tolist() == [maxent.ending(w) for w in flat]
    assert unit.hashes[unit.ids].tolist() == maxent.hashed(flat).tolist()


def test_units_are_scored_in_little_memory(monkeypatch):
    """Arrays of a whole unit are few: a worker's memory follows from the tokens of a unit."""
    monkeypatch.setattr(maxent.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    rng, docs, size, shards = np.random.default_rng(1), 4000, 100, 4
    texts = [" ".join(f"w{k}" for k in found) for found in (rng.zipf(1.3, (docs, size)) % 5000).tolist()]
    units = list(maxent._units(iter([pa.record_batch([pa.array(range(docs)), pa.array([False] * docs), pa.array(range(docs)), pa.array(texts)], ["doc_id", "held_out", "mark", "text"])])))
    classes = maxent.Classes([b"w1", b"w2"], np.arange(maxent.ENDINGS) % maxent.CLUSTERS, [b"w1", b"w2"])
    model = type("Model", (), {"value": (np.array([9, 8]), np.zeros(maxent.Weights().flat.size, np.float32), np.zeros(maxent.CLASSES), docs, np.full(maxent.GROUPS, 0.3))})
    peaks = []

    def watched(make):
        tracemalloc.start()
        out = make()
        peaks.append(tracemalloc.get_traced_memory()[1] / (docs * (size + 1)))
        tracemalloc.stop()
        return out

    asked = pa.Table.from_batches(watched(lambda: list(maxent._asked(shards, lambda: classes)(iter(units)))))
    told = pa.concat_tables(maxent._told(asked.slice(k, 1)) for k in range(shards))
    assert watched(lambda: maxent._scored(shards, model, lambda: classes)(pa.Table.from_batches(units), told)).num_rows == docs
    assert max(peaks) < 60, peaks  # bytes a token


def test_language_model_memory(spark, docs, monkeypatch):
    """The memory against counts of all pairs, in several units and shards; scores don't depend on the partitions."""
    monkeypatch.setattr(maxent, "UNIT_TOKENS", 5000)
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 20000)
    model = []
    keep = maxent._scored
    monkeypatch.setattr(maxent, "_scored", lambda shards, m, make: model.append((shards, m.value)) or keep(shards, m, make))
    df = spark.createDataFrame(list(zip(docs.doc_id.tolist(), docs.text)), "doc_id bigint, text string")
    runs = [{r.doc_id: r for r in maxent.score(df.repartition(n)).collect()} for n in (1, 2, 8)]
    for other in runs[1:]:
        assert all(math.isclose(r.score, other[i].score, rel_tol=1e-6) for i, r in runs[0].items())
    shards, (head, flat, log_mass, begins, share) = model[0]
    assert shards > 1
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    text = dict(zip(docs.doc_id.tolist(), docs.text))
    own, pairs = Counter(), Counter()
    for i, t in text.items():
        if not held(i):
            w = maxent.words(t)
            own.update(w)
            pairs.update(zip([None, *w], w))
    own[None] = begins
    assert begins == sum(not held(i) for i in text)
    ranked = sorted((w for w in own if w is not None), key=lambda w: (-own[w], w))
    group = {w: 2 + int(math.log2(k + 1)) for k, w in enumerate(ranked)} | {None: 0}
    n, again = np.zeros(maxent.GROUPS), np.zeros(maxent.GROUPS)
    for (a, _), c in pairs.items():
        n[group[a]] += c
        again[group[a]] += c if c > 1 else 0
    expected = np.minimum(np.divide(again, n, out=np.zeros_like(n), where=n > 0), maxent.MOST_MEMORY)
    assert np.allclose(share, expected)
    # A document whose every pair is known from elsewhere scores above one that is new.
    copies = [i for i in text if held(i) and any(text[j] == text[i] and not held(j) for j in text) and len((text[i] or "").split()) > 20]
    new = [i for i in text if held(i) and i not in copies and len((text[i] or "").split()) > 20]
    per = lambda ids: sum(runs[0][i].score for i in ids) / sum(runs[0][i].n_tokens for i in ids)
    assert not copies or per(copies) > per(new) + 0.5


@pytest.mark.parametrize("head", [8, maxent.HEAD])
def test_language_model_rare_words_in_units(spark, monkeypatch, head):
    """Counts of words beyond the head, or too long for it, over several units and shards whose dictionaries differ."""
    monkeypatch.setattr(maxent, "HEAD", head)
    monkeypatch.setattr(maxent, "UNIT_TOKENS", 300)
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 500)
    rng = np.random.default_rng(7)
    vocabulary = ["of", "it", *(f"w{k}" * (1 + k % 3 * 20) for k in range(300))]
    texts = [(k, " ".join(vocabulary[j] for j in np.minimum(rng.zipf(1.3, 40) - 1, len(vocabulary) - 1))) for k in range(150)]
    rows = maxent.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    check_scores(rows, texts)


def test_language_model_edges(edges, empty):
    check_scores(maxent.score(edges).collect(), EDGES)
    assert maxent.score(empty).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------------


def plain_spans(t):
    """The rule as it is written, with backtracking patterns."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        s = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(s) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found)


def test_personal_data_rule(docs):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("ab1234567890.@+-() "), 60)) for _ in range(3000)] + ["a@b.c-d_x@y.z", "1.2.3.4.5.6.7.8", "x@y.z@q.r", "0000001.2.3.4", "+1 (555) 555-0100", "4111 1111 1111 1111"]
    for t in [*made, *docs.text.tolist()]:
        assert pii.base_spans(t) == plain_spans(t)


def test_personal_data_additions():
    text = "My IBAN: GB82 WEST 1234 5698 7654 32, SSN 078-05-1120; serial 078-05-1120 far away from any of those telling words."
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)][:2] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "078-05-1120")]
    assert pii.spans("GB82 WEST 1234 5698 7654 33") == []
    assert pii.spans("1" * 200_000 + "." + "a" * 200_000 + "@" * 1000) == []  # linear


IBANS = ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947")


@pytest.mark.parametrize("after", ["", " BIC", " EUR 500", " OR CALL", " BIC COBADEFFXXX", " A B C D E F G H I J K L M N O P", " and", ", GB82"])
@pytest.mark.parametrize("before", ["", "REF 7 ", "AB12 ", "AB12 34 "])
def test_account_numbers_beside_capitals(before, after):
    for number in IBANS:
        t = f"{before}{number}{after}"
        assert [t[a:b] for k, a, b, _ in pii.spans(t) if k == "iban"] == [number]
    two = f"{IBANS[0]} {IBANS[2]}"
    assert [two[a:b] for k, a, b, _ in pii.spans(two) if k == "iban"] == [IBANS[0], IBANS[2]]
    assert pii.spans("DE89370400440532013001 BIC") == [] and not any(k == "iban" for k, *_ in pii.spans("DE89370400440532013000X"))


def test_account_numbers_take_linear_time():
    assert not any(k == "iban" for k, *_ in pii.spans("AA11 " * 40_000 + "AA11" * 40_000))


def test_personal_data_query(spark, sf, docs):
    """op2_pii over the whole table against the plain rule; base spans stay among all spans."""
    text = dict(zip(docs.doc_id.tolist(), docs.text))
    rows = queries.QUERIES["op2_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        want = plain_spans(text[r.doc_id] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        own = [x for x in r.spans.split(",") if x and x.split(":")[0] in pii.KINDS[:4]]
        assert ",".join(own) == listed


def test_personal_data_in_long_texts():
    """Many numbers in one text take linear time, and added spans overlap nothing."""
    text = "call 555-123-4567 or mail a@b.org, card 4111 1111 1111 1111. " * 4000
    began = time.process_time()
    found = pii.spans(text)
    assert time.process_time() - began < 10 and len(found) == 12_000
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_personal_data_edges(edges, empty):
    out = pii.mask(edges).collect()
    assert len(out) == len(EDGES) and sum("[EMAIL] now" in (r.text or "") for r in out) == 2 and sum(r.text is None for r in out) == 2
    assert pii.find(empty).count() == 0 and pii.find(edges).columns.count("pii") == 1


# 3, 9 --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokens.encoder(tokens.tokenizer_path())


def ids_of(library, text):
    return np.append(np.frombuffer(library.whole([text])[0] if text else b"", "<u4"), np.uint32(2))


def test_tokens_are_the_library_s(library, docs):
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("ab \n\t.,'s1é 日"), 40)) for _ in range(2000)] + ["<|endoftext|> x", "a" * 5000, "it's he'll", "x\r\n y"]
    for texts in (made, docs.text.tolist()):
        assert library.encode(texts) == library.whole(texts)


def test_units_are_kept_in_little_memory():
    """A kept unit takes under 100 bytes, so that a worker can keep many (175 in dictionaries)."""
    made = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in ("", "e", "fg", "hi", "ä", "s.", "t,", "1", "2-3", "é.")]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    encoder.encode(["warm up"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    encoder.encode([" " + " ".join(made)])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * len(made), held / len(made)


@pytest.mark.parametrize("limit", [0, 40, 1000])
def test_units_that_go_and_come_again(docs, monkeypatch, limit):
    """Ids are the library's whether units are kept or not, for words, marks, digits, other letters and long units."""
    monkeypatch.setattr(tokens, "CACHE_UNITS", limit)
    monkeypatch.setattr(tokens, "CACHE_PIECES", limit)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    words = ["one", "one.", "one,", "ärger", "ärger.", "日本", "日本.", "a.,", ".", "12", "12.", "x" * 100, "É", "\n", "\nline", "ª", "don't", "", "a\tb", "´"]
    rng = np.random.default_rng(3)
    for _ in range(30):
        texts = [" ".join(rng.choice(words, 20)) for _ in range(3)] + docs.text.tolist()[int(rng.integers(50)) :][:2]
        assert encoder.encode(texts) == encoder.whole(texts)


def test_texts_are_encoded_in_slices(library, docs, monkeypatch):
    """Slices hold all rows in order, a text beyond the limit is one of its own, and none changes the ids."""
    texts = [None, "", "a  b", *docs.text.tolist()[:50], "x y\n" * 3000, None, "end"]
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 5000)
    monkeypatch.setattr(tokens, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(tokens, "UNITS_AT_ONCE", 100)
    found = [s.column(0).to_pylist() for s in tokens.slices(pa.record_batch([pa.array(texts, pa.string())], ["text"]), 0)]
    assert [t for s in found for t in s] == texts and max(map(len, found)) <= 7
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 5000 for s in found)
    ids = [x for s in found for x in tokens.encode_documents(s, tokens.tokenizer_path())]
    assert [x.tolist() for x in ids] == [ids_of(library, t).tolist() for t in texts]
    assert list(tokens.encode_documents([], tokens.tokenizer_path())) == []


def test_id_store(spark, sf, library, docs):
    rows = queries.QUERIES["op3_token_ids"](spark, sf).collect()
    before = 0
    for (i, t), r in zip(sorted(zip(docs.doc_id.tolist(), docs.text)), sorted(rows, key=lambda r: r.doc_id)):
        ids = ids_of(library, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_id_store_edges(spark, edges, empty, library, tmp_path):
    idstore.write(edges, str(tmp_path / "a"))
    rows = idstore.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == sorted((str(i), tuple(ids_of(library, t).tolist())) for i, t in EDGES)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in EDGES), key=lambda i: (i is not None, i))
    idstore.write(empty, str(tmp_path / "b"))
    assert idstore.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 300, 70_000])
def test_huffman_codes(n):
    rng = np.random.default_rng(n)
    counts = np.maximum(rng.pareto(0.5, n), 1).astype(np.int64)
    limit = idstore.limit_for(n)
    lengths = idstore.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths > 0).all()
    assert n == 1 or math.isclose((0.5 ** lengths.astype(float)).sum(), 1)  # complete
    ids = rng.integers(0, n, 5000)
    stream, start = idstore.encode_bits(ids, idstore.canonical(lengths), lengths)
    assert (idstore.Table(lengths).decode(stream, start[::256], len(ids), 256) == ids).all()


def test_huffman_is_optimal_without_a_tight_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 50)
    heap, total = sorted(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert (idstore.code_lengths(counts, 16) * counts).sum() == total


def check_packing(rows, texts, library, capacity):
    want = Counter((str(i), len(ids_of(library, t))) for i, t in texts)
    by_row = {}
    for r in rows:
        by_row.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_row.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = Counter()
    for r in rows:
        total[str(r.doc_id)] += r.length
    assert total == Counter({i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in want})
    return len(by_row), sum(total.values())


def test_packing(spark, sf, library, docs):
    rows = queries.QUERIES["op9_packing"](spark, sf).collect()
    n, total = check_packing(rows, list(zip(docs.doc_id.tolist(), docs.text)), library, 1024)
    assert n <= math.ceil(total / 1024) * 1.02 + 1
    ids = {i: ids_of(library, t) for i, t in zip(docs.doc_id.tolist(), docs.text)}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert all(r.piece == 0 or r.length == 1024 for r in rows)


def test_packing_edges(edges, empty, library):
    check_packing(packing.pack(edges, capacity=64).collect(), EDGES, library, 64)
    assert packing.pack(empty).count() == 0


def test_plan_keeps_counts():
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in zip(range(1, 101), rng.integers(0, 10**9, 100)) if v}
    runs = packing.plan(counts, 100)
    assert len(runs) < 2000
    for length, n in counts.items():
        own = sorted((r, k) for size, r, k, _, _ in runs if size == length)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    rows = max(first + k for _, _, k, first, _ in runs)
    assert rows <= sum(k * v for k, v in counts.items()) / 100 * 1.05


# 4 -----------------------------------------------------------------------------------------------------------------------


def test_archives_with_magic_inside(spark, tmp_path):
    inner = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n".decode()
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (None, "http://c", "same"), (3, "http://d", None), (4, "u", inner * 3 + "WARC/1.0\r\n"), (5, "u", "é" * 5000), (5, "u", "é" * 5000)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write(warc.records(pages), str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {1: ("revisit", 2), None: ("revisit", 2)}
    want = sorted((str(i), len((t or "").encode()), sha(t), *(kind.get(i, ("response", None)))) for i, _, t in rows)
    assert got == want
    warc.write(warc.records(pages.filter("page_id = 99")), str(tmp_path / "e"))
    assert list((tmp_path / "e").glob("part-*")) == [] or warc.read(spark, str(tmp_path / "e")).count() == 0


def test_pointer_jumping():
    rng = np.random.default_rng(3)
    for _ in range(50):
        at = np.unique(np.append(0, rng.integers(0, 300, 40)))
        after = np.array([rng.choice(at[at > a]) if (at > a).any() and rng.random() < 0.9 else 10_000 for a in at])
        want, k = set(), 0
        while k in at.tolist():
            want.add(k)
            k = int(after[at.tolist().index(k)])
        assert set(at[warc.reachable(at, after)].tolist()) == want
    assert len(warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


# 5 -----------------------------------------------------------------------------------------------------------------------


def components(prints):
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
    label = np.arange(len(p))
    while True:
        new = np.where(near, label[None, :], len(p)).min(1)
        if (new == label).all():
            return label
        label = new


def test_near_duplicates(spark, sf, docs):
    from xxhash import xxh64_intdigest

    def one(t):
        w = t.encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = docs.sort_values("doc_id")
    prints = [one(t) for t in docs.text]
    label = components(prints)
    ids = docs.doc_id.tolist()
    want = [(i, f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, label)]
    assert sorted(tuple(r) for r in queries.QUERIES["op5_simhash"](spark, sf).collect()) == want


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_keep_components(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    p = np.unique(rng.choice(base, 400) ^ flip() ^ flip())
    want = components(p)
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, tile)).collect()}
    got = {}
    for x, k in zip(p.view(np.int64).tolist(), want.tolist()):
        got.setdefault(root.get(x, x), set()).add(k)
    assert sorted(map(tuple, got.values())) == sorted((k,) for k in set(want.tolist()))


def test_near_duplicate_edges(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    blank = [r for r in rows if r.print == 0]
    assert len(rows) == len(EDGES) and len(blank) == 4 and {r.component_id for r in blank} == {1}
    kept = simhash.deduplicate(edges).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["0", "None", "1", "4", "5", "-7"]) and len(kept[0]) == 2 + len(CLASH)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def jaccard_components(texts):
    """The smallest index of each text's component under five-word Jaccard 0.8, by comparing all pairs that share a shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        met = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in met.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(j), top(k)))
                root[b] = a
        for x in s:
            holders.setdefault(x, []).append(k)
    return [top(k) for k in range(len(sets))]


def near_copies(seed=3, n=60):
    """Texts and chains of copies of them, each with a few words of its predecessor replaced: on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        text = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, 200))]
        for _ in range(rng.integers(1, 6)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.integers(1, 1 + max(1, len(text) // 40))):
                text[rng.integers(0, len(text))] = f"x{rng.integers(0, 10**9)}"
    return out + ["", None, " ", "a b c", "A b  c", "a b d"]


def test_near_duplicates_stage_finds_all_near_copies(spark, docs):
    import corpus_pipeline as c

    for texts in (near_copies(), docs.text.tolist()):
        want = sorted(set(jaccard_components(texts)))
        kept = c.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None)
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_near_copies_in_tiles(spark):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"x{j}"] + base[k + 1 :]) for j, k in enumerate(rng.integers(0, 120, 90))] + near_copies(4, 10)
    nodes = spark.createDataFrame(list(enumerate(texts)), "number long, text string").withColumn("s", F.arrow_udf(minhash._sketches, "struct<print:bigint,keys:array<bigint>>")("text"))
    nodes = nodes.groupBy("s.print").agg(F.min("number").alias("number"), F.first("s.keys").alias("keys"))
    texts_ = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    found = [{tuple(sorted(x)) for x in simhash.components(minhash.links(nodes, texts_, t)).collect()} for t in (7, 512)]
    assert found[0] == found[1] and len(found[0]) >= 89


def test_near_copies_come_from_simhash_too(spark, monkeypatch):
    """Without any min-hash key, copies within three bits are candidates by their fingerprints; the exact check follows."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (50, 150, 250)] + [" ".join(base), "w0 w1 w2 w3 w4 w5", "red"]
    near = [k for k, t in enumerate(texts) if (simhash.fingerprint(t) ^ simhash.fingerprint(texts[3])).bit_count() <= 3]
    assert len(near) > 1 and set(near) <= {0, 1, 2, 3}
    marks = minhash._marks(pa.array(texts)).to_pylist()
    nodes = spark.createDataFrame([(m["print"], k, []) for k, m in enumerate(marks)], "print long, number long, keys array<long>")
    more = minhash.simhash_keys(spark.createDataFrame([(m["print"], m["fingerprint"]) for m in marks], "print long, fingerprint long"))
    texts_ = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    found = simhash.components(minhash.links(nodes, texts_, more=more)).collect()
    joined = {x for r in found for x in r}
    assert {marks[k]["print"] for k in near} <= joined and not {marks[4]["print"], marks[5]["print"]} & joined
    assert minhash.links(nodes, texts_).count() == 0
    # The stage takes these keys along.
    taken, own = [], minhash.simhash_keys
    monkeypatch.setattr(minhash, "simhash_keys", lambda df: taken.append(df.count()) or own(df))
    assert minhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 3 and taken == [6]


def test_near_copies_edges(edges, empty):
    assert sorted(str(r.doc_id) for r in minhash.deduplicate(edges).collect()) == sorted(map(str, [0, None, 1, 4, 5, -7]))
    assert minhash.deduplicate(edges).columns == edges.columns and minhash.deduplicate(empty).count() == 0


def test_deduplicate_with_null_and_repeated_ids(spark):
    texts = ["one two three four", "five six seven eight", "nine ten eleven twelve", "red green blue grey"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[2]), (3, texts[0]), (None, texts[0])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted([(texts[0], 3), (texts[1], None), (texts[2], 7), (texts[3], 7)])


# 6 -----------------------------------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "A!"), (0, 2, "user", "bye"), (1, 0, "user", None), (1, 1, "assistant", "B"), (2, 0, None, "x"), (None, 0, "user", "z"), (0, 1, "assistant", "A!")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat.preference(chat.with_alternative(chat.conversations(df))).collect()}
    assert set(out) == {0, 1, 2}
    a = out[0]
    assert a.n_common == 2 and a.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nA!<|end|>\n"
    assert a.chosen == "<|assistant|>\nA!<|end|>\n" and a.rejected == "<|assistant|>\nB<|end|>\n"
    assert [a.chosen[m.start : m.end] for m in a.chosen_mask] == ["A!<|end|>\n"] and [a.rejected[m.start : m.end] for m in a.rejected_mask] == ["B<|end|>\n"]
    assert out[2].chosen == "" and out[2].prompt == "<|unknown|>\nx<|end|>\n" and out[2].rejected_mask == []
    assert chat.conversations(df.filter("turn = 99")).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------------


def test_transport_streams(docs):
    for t in [None, "", "a", LONG, *docs.text.tolist()]:
        n, payload = mpegts.padded(t)
        stream = mpegts.mux(payload)
        got = mpegts.demux(stream)
        assert got["payload"] == payload and len(payload) % 192 == 0 and payload[:n] == (t or "").encode() and got["errors"] == 0
        assert [u["pts"] for u in got["units"]] == [k * mpegts.TICKS for k in range(len(got["units"]))]
        assert [u["random_access"] for u in got["units"]] == [k % mpegts.RAP_EVERY == 0 for k in range(len(got["units"]))]


def test_transport_stream_faults():
    stream = mpegts.mux(mpegts.padded("x" * 5000)[1])
    lost = mpegts.demux(stream[: 188 * 5] + stream[188 * 6 :])
    again = mpegts.demux(stream[: 188 * 6] + stream[188 * 5 :])
    assert lost["errors"] == 1 and again["errors"] == 0 and again["payload"] == mpegts.padded("x" * 5000)[1]
    broken = bytearray(stream)
    broken[20] ^= 1  # a table with a wrong checksum isn't used
    assert mpegts.demux(bytes(broken))["units"] == [] and mpegts.demux(b"")["packets"] == 0


def test_media_column(spark, sf, docs, edges, empty):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_media"](spark, sf).collect()}
    for i, t in zip(docs.doc_id.tolist(), docs.text):
        p = mpegts.padded(t)[1]
        assert (rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    out = edges.withColumn("media", mpegts.write("text")).withColumn("parsed", mpegts.parse("media"))
    assert sorted(r.parsed.payload for r in out.collect()) == sorted(mpegts.padded(t)[1] for _, t in EDGES)
    assert empty.withColumn("media", mpegts.write("text")).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------------


def test_containment(spark):
    item = " ".join(f"w{k}" for k in range(24))  # 20 shingles
    part = " ".join(f"w{k}" for k in range(20))  # 16 of them, just enough
    less = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"Before, {item.upper().replace(' ', ', ')}! after"), (2, part + " z " + LONG), (3, less), (None, item), (4, None), (5, ""), (1, "other"), (6, "w1 w2")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item), (10, " .,; ")], "item_id long, text string")
    for few in (0, 1000):  # texts shuffled, ids broadcast
        got = sorted((str(r.doc_id), r.item_id, r.n_shared) for r in decontaminate.contained(docs, items, broadcast_rows=few).collect())
        assert got == [("1", 7, 20), ("2", 7, 16), ("None", 7, 20)]
    kept = decontaminate.clean(docs, items)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in [rows[2], *rows[4:]]) and kept.columns == docs.columns
    short = spark.createDataFrame([(11, "Other"), (12, "w18, w19 z w0x0"), (13, "w1 w2"), (14, "w2 w1")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contained(docs, short).collect())
    assert got == [("1", 11), ("1", 13), ("2", 12), ("2", 13), ("3", 13), ("6", 13), ("None", 13)]
    assert decontaminate.contained(docs.filter("doc_id = 99"), items).count() == 0 and decontaminate.clean(docs, items.filter("item_id = 99")).count() == len(rows)


def test_containment_by_brute_force(spark, docs):
    """Items cut from texts at random, with words replaced, of all sizes; a phrase that all items share."""
    rng = np.random.default_rng(8)
    texts = [(int(i), t or "") for i, t in zip(docs.doc_id, docs.text)][:120]
    found = []
    for k in range(60):
        w = decontaminate_words(texts[int(rng.integers(120))][1])
        n = int(rng.integers(1, 60))
        if len(w) > n:
            at = int(rng.integers(len(w) - n))
            own = w[at : at + n]
            for j in rng.integers(0, n, int(rng.integers(0, 3))):
                own[int(j)] = "changed"
            found.append((k, " ".join(["the shared phrase of all items here"] * (k % 2) + own)))
    df, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(found, "item_id long, text string")
    of = lambda w, n: {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = set()
    for k, t in found:
        n = min(len(t.split()), 5)
        own = of(t.split(), n)
        for i, d in texts:
            shared = len(own & of(decontaminate_words(d), n))
            if shared >= math.ceil(0.8 * len(own) - 1e-9):
                want.add((i, k, shared))
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(df, items).collect()} == want and want


def decontaminate_words(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]


# 10 ----------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(sf):
    big = sf.replace("0.001", "0.1")
    docs = pq.read_table(f"{big}/documents.parquet").to_pandas().merge(pq.read_table(f"{big}/labels.parquet").to_pandas())
    train, test = docs[:1500], docs[2000:3000]
    made = [toxicity.features(t) for t in train.text]
    y = np.stack([1 - train.quality, train.toxic], 1).astype(float)
    chain, out_of_fold = toxicity.train_chain(made, y, np.arange(len(train)) % toxicity.FOLDS)
    assert len(chain[1].chain) == 1 and out_of_fold.shape == y.shape
    score = toxicity.Scorer(chain)
    hit = np.array([score(t)[1] >= chain[1].threshold for t in test.text])
    assert (hit & (test.toxic == 1)).sum() >= 0.85 * test.toxic.sum() and (hit & (test.toxic == 0)).sum() <= 0.01 * len(test)
    own = toxicity.features(test.text.iloc[0])
    assert math.isclose(score(test.text.iloc[0])[0], 1 / (1 + math.exp(-chain[0].logit(own, []))), rel_tol=1e-9)


def test_toxicity_query(spark, sf, docs):
    """op10_toxicity against the chain applied text by text, without Spark."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.fit_labelled(df, labels, toxicity.CATEGORIES)
    rows = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, t in zip(docs.doc_id.tolist(), docs.text):
        found, logits = toxicity.features(t), []
        for m in chain:
            own = dict(zip(m.keys.tolist(), m.weights.tolist()))
            logits.append(m.bias + sum(own.get(x, 0.0) for x in found.tolist()) + sum(c * x for c, x in zip(m.chain, logits)))
        p = [1 / (1 + math.exp(-min(max(x, -40), 40))) for x in logits]
        assert math.isclose(rows[i].p_low_quality, p[0], rel_tol=1e-6) and math.isclose(rows[i].p_toxic, p[1], rel_tol=1e-6)
        assert rows[i].rejected == (p[1] >= chain[1].threshold)


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(0, 1, 1), (1, None, 0), (None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_labelled(edges, labels, toxicity.CATEGORIES)
    out = toxicity.classify(edges, chain, list(toxicity.CATEGORIES))
    assert out.count() == len(EDGES) and all(0 <= r.toxicity.p_toxic <= 1 for r in out.collect())
    none = toxicity.fit_labelled(edges, labels.filter("doc_id = 99"), toxicity.CATEGORIES)
    assert toxicity.reject_toxic(edges, none).count() == len(EDGES) and toxicity.reject_toxic(empty, chain).count() == 0


# Pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0.6 * n < docs.count() <= n
    packed = c.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert c.pack(spark, docs.filter("doc_id < 0"), sf).count() == 0 and isinstance(pa.__version__, str)


def test_pipeline_stages_on_edges(spark, sf, edges, empty):
    """Nulls, repeated rows, a very long text and clashing names through every stage; empty tables."""
    import corpus_pipeline

    own = edges.select(*edges.columns, F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    now, none = own, own.filter("doc_id = 99")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, now, sf)
        assert stage(spark, none, sf).count() == 0, name
        if name != "packing":
            assert got.columns == own.columns, name
            rows = got.select("doc_id", "text").collect()
            before = Counter((r.doc_id, r.text) for r in now.select("doc_id", "text").collect())
            if name == "near_duplicates":  # one of the repeated rows, one of the texts without words, and all others
                assert sorted(str(r.doc_id) for r in rows) == sorted(["0", "None", "1", "4", "5", "-7"])
            elif name == "personal_data":
                assert {r.text for r in rows if r.doc_id == 0} == {"Mail [EMAIL] now"}
            else:
                assert Counter((r.doc_id, r.text) for r in rows) == before, name
            now = spark.createDataFrame(got.collect(), got.schema)
        else:
            assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_pipeline_by_brute_force(spark, sf, docs, library):
    """What the pipeline packs, from plain Python: the chain text by text, exact Jaccard over all pairs, exact containment,
    masked spans, and the library's ids."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    chain = toxicity.fit_labelled(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), toxicity.CATEGORIES)
    score = toxicity.Scorer(chain)
    text = {i: t or "" for i, t in zip(docs.doc_id.tolist(), docs.text) if score(t)[1] < chain[1].threshold}

    def grams(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()

    sets, root = {i: grams(t) for i, t in text.items()}, {i: i for i in text}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(text)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = [i for i in ids if top(i) == i]
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    of = lambda w, n: {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
    wanted = [(n, of(w, n)) for w in map(decontaminate_words, items.text) if (n := min(len(w), 5))]
    clean = [i for i in kept if not any(len(s & of(decontaminate_words(text[i]), n)) >= math.ceil(0.8 * len(s) - 1e-9) for n, s in wanted)]
    masked = {}
    for i in clean:
        t, at, parts = text[i], 0, []
        for kind, a, b, _ in pii.spans(t):
            if a >= at:
                parts += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        masked[i] = "".join([*parts, t[at:]])
    assert len(clean) < len(kept) < len(text) <= len(docs)
    want = {i: b + (2).to_bytes(4, "little") for i, b in zip(masked, library.whole(list(masked.values())))}
    got = Counter()
    for r in out:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        got[r.doc_id] += r.length
    assert got == {i: len(b) // 4 for i, b in want.items()}
