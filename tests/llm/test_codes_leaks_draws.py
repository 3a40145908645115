"""Vector codes, decontamination and resampling against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mosaiq.llm")

from mosaiq.llm import decontamination, queries, resampling, vector_codes  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OLD = {"hits": 1, "runs": 2, "row_id": 3, "rank": 4, "score": 5, "place": 6, "item": 7, "words": 8, "code": 9, "error": 10, "label_error": 11, "c": 12, "v": 13, "__place": 14, "id": 15}
VECTORS, DOCS = "vec_id long, embedding array<double>, label int", "doc_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def with_old_names(df):
    return df.withColumns({k: F.lit(v) for k, v in OLD.items() if k not in df.columns})


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_decontamination", "op13_resampling"])
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=str) == sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall(), key=str)


# Vector codes


def codes_by_brute_force(rows, n_parts, k, rounds):
    """``{row number: (code, error)}`` and the books, one Lloyd round after the other in plain integers."""
    kept = [(i, v) for i, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // n_parts)
    cut = {i: [tuple(math.floor(256 * x) for x in (v + [0.0] * (width * n_parts))[p * width : (p + 1) * width]) for p in range(n_parts)] for i, v in kept}
    order = sorted(cut, key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))
    books = [[cut[i][p] for i in order[:k]] for p in range(n_parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        at = {i: [nearest(part, p)[1] for p, part in enumerate(cut[i])] for i in cut}
        for p in range(n_parts):
            for j in range(len(books[p])):
                mine = [cut[i][p] for i in cut if at[i][p] == j]
                if mine:
                    books[p][j] = tuple(sum(c) // len(mine) for c in zip(*mine))
        books = [list(b) for b in books]
    found = {i: [nearest(part, p) for p, part in enumerate(cut[i])] for i in cut}
    return {i: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def awkward_vectors(seed):
    r = random.Random(seed)
    grid = lambda n: [r.randrange(-3, 4) / 256 for _ in range(n)]  # noqa: E731  many ties
    rows = [(r.choice([None, *range(40)]), grid(r.choice([8, 8, 8, 7, 3])), r.choice([None, 1, 2])) for _ in range(150)]
    rows += [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [math.nan] * 8, None), (8, [math.inf] + [0.0] * 7, 2), (9, [], None), (9, [0.0] * 8, None), (9, [0.0] * 8, None)]
    return rows + [(10, [2e5, -2e5] * 4, 3), (11, [-0.001] * 8, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_of_awkward_vectors(spark, seed):
    rows = awkward_vectors(seed)
    wanted, books = codes_by_brute_force(rows, 4, 5, 2)
    df = vector_codes.compress(with_old_names(spark.createDataFrame(rows, VECTORS).repartition(5)), n_parts=4, entries=5)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    sums = Counter()
    for i, (_, error) in wanted.items():
        sums[rows[i][2]] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    expected = sorted(((rows[i][0], code, error, sums[rows[i][2]], digest) for i, (code, error) in wanted.items()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == expected


def test_exponion_finds_what_a_full_scan_finds_from_any_start():
    r = np.random.default_rng(3)
    for scale in (2, 40, 1 << 20):
        entries = r.integers(-scale, scale, (3, 17, 4))
        entries[:, 5] = entries[:, 2]
        parts = r.integers(-scale, scale, (200, 3, 4))
        parts[:20] = entries[:, r.integers(0, 17, 20)].transpose(1, 0, 2)
        far = ((parts[:, :, None] - entries) ** 2).sum(-1)
        at, best = vector_codes.Exponion(entries).nearest(parts, r.integers(0, 17, (200, 3)))
        assert (at == far.argmin(-1)).all() and (best == far.min(-1)).all()


def test_exponion_scans_little_near_its_start():
    r = np.random.default_rng(4)
    entries = np.arange(64)[None, :, None] * np.full((1, 1, 4), 1000)
    parts = entries[:, r.integers(0, 64, 500)].transpose(1, 0, 2) + r.integers(-50, 50, (500, 1, 4))
    search = vector_codes.Exponion(entries)
    start = search.nearest(parts, np.zeros((500, 1), dtype=np.int64))[0]
    assert (search.between[0][start[:, 0], 1] > 4 * search.nearest(parts, start)[1][:, 0]).all()  # the second entry is out of reach already


def test_vector_codes_of_extreme_and_empty_tables(spark):
    schema = VECTORS
    for rows in ([], [(1, None, 1)], [(1, [math.nan], None)]):
        assert vector_codes.compress(spark.createDataFrame(rows, schema)).count() == 0
    found = vector_codes.compress(spark.createDataFrame([(1, [], None), (2, [], 1)], schema)).collect()
    assert [(r["code"], r["error"]) for r in found] == [("00" * 16, 0)] * 2
    huge = vector_codes.compress(spark.createDataFrame([(i, [1e308 * (-1) ** i] * 64, 1) for i in range(70)], schema)).collect()
    assert len(huge) == 70 and all(0 <= r["error"] <= 2**60 for r in huge)


def test_labels_beyond_the_map_side(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_LABELS", 1)
    rows = awkward_vectors(3)
    wanted, _ = codes_by_brute_force(rows, 4, 5, 2)
    sums = Counter()
    for i, (_, error) in wanted.items():
        sums[rows[i][2]] += error
    found = vector_codes.compress(spark.createDataFrame(rows, VECTORS), n_parts=4, entries=5)
    assert Counter(r["label_error"] for r in found.collect()) == Counter(sums[rows[i][2]] for i in wanted)


def test_codes_can_be_decoded(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.fit(vectors)
    for r in vector_codes.encode(vectors.limit(20), books).collect():
        v = np.floor(256 * np.array(r["embedding"], dtype=float)) / 256
        assert ((v - books.decode(r["code"]["code"])) ** 2).sum() * 256**2 == pytest.approx(r["code"]["error"])


# Decontamination


def leaks_by_brute_force(docs, items, window):
    wins = {}
    for item, text in items:
        w = terms(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    for doc, text in docs:
        w, hit, met = terms(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    met |= wins[tuple(w[i : i + n])]
        yield doc, len(w), hit, sorted(met)


def leaky(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "c", "Übung", "漢字", "x1"])
    text = lambda n: r.choice([" ", "-", ", ", "\n"]).join(word() for _ in range(n))
    items = [(r.choice([None, 1, 2, 3, 10, 11, 12]), text(r.choice([1, 2, 3, 4, 5, 12, 30]))) for _ in range(12)] + [(50, None), (51, ""), (52, "!?"), (10, "b a c a b a c a b")]
    docs = [(r.choice([None, *range(30)]), text(r.choice([0, 1, 3, 7, 20, 60]))) for _ in range(n)]
    docs += [(1, None), (2, ""), (3, "\0 . \0"), (4, "zz " * 50_000 + (items[-1][1] + " ") * 3), (4, items[-1][1].upper())]
    return docs, items


def leaks_of(df):
    return sorted(((r["doc_id"], r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"], r["hits"]["runs"]) for r in df.collect()), key=str)


def runs_of(hit):
    edges = [i for i in hit if i - 1 not in hit] + [i + 1 for i in hit if i + 1 not in hit]
    return sorted(edges)


@pytest.mark.parametrize("way", ["one slice", "slices", "collisions", "chunks"])
def test_leaks_in_awkward_texts(spark, monkeypatch, way):
    if way == "slices":
        monkeypatch.setattr(decontamination, "SLICE_BYTES", 60)
        monkeypatch.setattr(decontamination, "PIECE", 3)
    docs, items = leaky(7)
    df, tests = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    wanted = list(leaks_by_brute_force(docs, items, 5))
    if way in ("one slice", "slices"):
        found = decontamination.scan(with_old_names(df), with_old_names(tests), window=5)
        assert [c for c in found.columns if c != "hits"] == [c for c in with_old_names(df).columns if c != "hits"]
        assert leaks_of(found) == sorted(((d, n, len(hit), met, runs_of(hit)) for d, n, hit, met in wanted), key=str)
        return
    if way == "collisions":  # every hash is a sum of numbers
        monkeypatch.setattr(decontamination, "_FACTOR", np.uint64(1))
    pieces = [("" if i is None else str(i), min(5, len(terms(t))), terms(t)) for i, t in items if terms(t)]
    test_set = decontamination.TestSet(pieces)
    texts = [(t or "").encode() for _, t in docs]
    for chunk in ([texts] if way == "collisions" else [[t] for t in texts]):
        n_words, n_hit, runs, met = test_set.scan(chunk)
        for i, text in enumerate(chunk):
            _, n, hit, items_ = wanted[texts.index(text)]
            assert (n_words[i], n_hit[i], met[i], list(runs[i])) == (n, len(hit), items_, runs_of(hit))


def test_leaks_are_removed(spark):
    docs, items = leaky(8)
    df, tests = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    wanted = list(leaks_by_brute_force(docs, items, 5))
    kept = decontamination.without_documents(df, tests, window=5)
    assert Counter(map(tuple, kept.collect())) == Counter(row for row, (_, _, hit, _) in zip(docs, wanted) if not hit)
    cut = {}
    for r in decontamination.without_spans(df, tests, window=5).collect():
        cut.setdefault(r["doc_id"], []).append(r["text"])
    for (doc, text), (_, _, hit, _) in zip(docs, wanted):
        left = [w for i, w in enumerate(terms(text)) if i not in hit]
        assert any(terms(t) == left and (hit or t == text) for t in cut[doc])
    one = spark.createDataFrame([(1, "Keep, this: The Answer is 42! and  that.")], DOCS)
    answer = spark.createDataFrame([(1, "the answer is 42")], "item_id long, text string")
    assert decontamination.without_spans(one, answer).first()["text"] == "Keep, this: ! and  that."


def test_leaks_of_empty_tables(spark):
    none, tests = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words")], DOCS)
    assert decontamination.scan(none, tests).count() == 0
    assert leaks_of(decontamination.scan(one, tests)) == [(1, 2, 0, [], [])]
    assert decontamination.scan(none, spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0


# Resampling


def draw_by_brute_force(docs, targets, run, buckets, percent, least):
    features = lambda text: [" ".join(w[i : i + n]) for w in [terms(text)] for n in range(1, run + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], targets))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        weight = sum(gain[bucket(f)] for f in features(text))
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(terms(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = percent * len(order) // 100
    return rows, order[:n]


@pytest.mark.parametrize("run, buckets, percent", [(1, 10_000, 10), (2, 7, 35), (3, 1, 100), (1, 50, 0)])
def test_draws_from_awkward_texts(spark, run, buckets, percent):
    r = random.Random(run)
    words = ["a", "B", "c", "Übung", "漢字", "x1", "d", "e"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 6, 40])))
    docs = [(r.choice([None, -5, 2**62, *range(60)]), text()) for _ in range(300)] + [(3, None), (3, ""), (4, "big " * 60_000)] + [(77, "a b c d e")] * 30
    targets = [text() for _ in range(20)] + [None, ""]
    df = with_old_names(spark.createDataFrame(docs, DOCS).repartition(5))
    found = resampling.resample(df, spark.createDataFrame([(t,) for t in targets], "text string"), percent=percent, least_words=5, run=run, buckets=buckets).collect()
    rows, drawn = draw_by_brute_force(docs, targets, run, buckets, percent, 5)
    assert Counter((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in found) == Counter(x[:4] for x in rows)
    ranked = sorted((x for x in found if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, len(drawn) + 1))
    assert [(x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in ranked] == [x[:4] for x in drawn]


def test_draws_of_empty_tables_and_drawn_documents(spark, sf_dir):
    none = spark.createDataFrame([], DOCS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(docs, none.select("text")).where("rank IS NOT NULL").count() > 0
    ranked = resampling.resample(docs, docs, percent=25)
    drawn = resampling.drawn_documents(docs, ranked)
    assert drawn.columns == docs.columns and drawn.count() == ranked.where("rank IS NOT NULL").count()
    with pytest.raises(ValueError):
        resampling.fit(docs, docs, buckets=1 << 30)
