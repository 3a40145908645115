"""Texts, samples, scores, panels, groups: against plain Python and worked cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import encode
from mosaiq.functions import text as T
from mosaiq.operators import diversity, grouping, sampling, scoring, selection
from mosaiq.plans.constants import AFFINITY
from mosaiq.sources import tables
from mosaiq.streaming.scoring import score_new_files


@pytest.mark.parametrize(
    "text,size,valid",
    [("x" * 19, 19, False), ("x" * 20, 20, True), ("x" * 300, 300, True), ("x" * 301, 300, True), ("x" * 249 + "?" + "x" * 100, 250, True), ("x" * 20 + "." + "x" * 400, 300, True), ("x" * 21 + "." + "x" * 400, 22, True), (None, 0, False)],
)
def test_postprocess(spark, text, size, valid):
    r = spark.createDataFrame([(text,)], "t string").select(T.postprocess(F.col("t")).alias("p")).first()["p"]
    assert (len(r["text"]), r["is_valid"]) == (size, valid)


def test_tokens_and_lists(spark):
    texts = ["a  b\tc\n", "", None, "　가 나\xa0다", "x"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.tokens(F.col("t"))).collect()]
    assert got == [(t or "").split() for t in texts]
    rows = spark.createDataFrame([("['a', 'b']",), ("plain",), ("",), (None,), ('["x"]',)], "t string").select(T.list_or_string(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a", "b"], ["plain"], [], [], ["x"]]


def test_bleu(spark):
    rows = [(0, 0, "a a b c"), (0, 1, "a b b"), (0, 2, "x y"), (1, 0, "only"), (2, 0, None), (2, 1, "a")]
    df = spark.createDataFrame(rows, "g int, o int, t string")
    d = {(r["g"], r["i"], r["j"]): r["dist"] for r in diversity.lexical(df, "g", "o", "t").collect()}
    assert d[0, 0, 1] == 0.5 and d[0, 0, 2] == 1 and d[0, 1, 2] == 1 and d[2, 0, 1] == 1
    r = {x["g"]: x for x in diversity.report(df, diversity.lexical(df, "g", "o", "t"), "g").collect()}
    assert abs(r[0]["mean_score"] - 0.833333) < 1e-6 and (r[0]["worst_i"], r[0]["worst_j"]) == (0, 1)
    assert r[1]["mean_score"] == 0 and not r[1]["passed"]


def test_bleu_random(spark):
    rng = random.Random(0)
    rows = [(g, o, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))) for g in range(30) for o in range(2)]
    text = {(g, o): t.split() for g, o, t in rows}
    for r in diversity.lexical(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t").collect():
        a, b = Counter(text[r["g"], 0]), Counter(text[r["g"], 1])
        n = sum(a.values())
        assert abs(r["dist"] - (1 - (sum((a & b).values()) / n if n else 0))) < 1e-12


def test_gate(spark):
    long, other = "one two three four five six", "seven eight nine ten eleven"
    rows = [(0, 0, 0, long), (0, 1, 0, long), (0, 1, 1, other), (1, 0, 0, None), (1, 0, 1, long), (1, 1, 0, other)]
    got = {(r["request"], r["slot"]): (r["attempt"], r["text"], r["passed"]) for r in diversity.gate(spark.createDataFrame(rows, "request int, slot int, attempt int, text string")).collect()}
    assert got == {(0, 0): (0, long, True), (0, 1): (1, other, True), (1, 0): (1, long, True), (1, 1): (0, other, True)}


@pytest.mark.parametrize("sizes,n,want", [((100, 100, 100), 90, (30, 30, 30)), ((10, 100, 100), 90, (10, 40, 40)), ((10, 20, 100), 90, (10, 20, 60)), ((5, 6, 7), 90, (5, 6, 7)), ((100, 100, 100), 100, (33, 33, 34))])
def test_water_fill(spark, sizes, n, want):
    df = spark.createDataFrame([(c, s) for c, s in zip("abc", sizes)], "stratum string, size long")
    assert tuple(r["quota"] for r in sampling.water_fill(df, n).orderBy("stratum").collect()) == want


def test_scores(spark):
    f = lambda h, s, ok: spark.range(1).select(scoring.fused(F.lit(h), F.lit(s), F.lit(ok), 0.5, 1.5)).first()[0]
    assert abs(f(4.0, 2.0, True) - 2.5) < 1e-6 and abs(f(0.0, 2.0, False) - 2.0) < 1e-6
    sims = spark.createDataFrame([(1, 0.9, 5.0, 1.0), (1, 0.6, 2.0, 4.0), (1, 0.5, 9.0, 9.0)], "k int, sim double, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in scoring.weighted_neighbours(sims, ["a", "b"], "k", spark.createDataFrame([(1,), (2,)], "k int")).collect()}
    assert got[2] == (0, 0) and abs(got[1][0] - 3.8) < 1e-9 and abs(got[1][1] - 2.2) < 1e-9


def test_matrix_either_way(spark):
    turned = {t: {a: row[t] for a, row in AFFINITY.items()} for t in selection.TAGS}
    rows = lambda m: sorted(tuple(r) for r in selection.long_matrix(spark, m).collect())
    assert rows(AFFINITY) == rows(turned) == rows({"matrix": AFFINITY})


def test_tags(spark):
    want = {(("그냥갖고싶음", "SNS광고"), "문구·다꾸", 9000): ["자기 중심적", "적극적 소비", "소극적 실속"], (("x",), "y", None): ["자기 중심적"], ((), "굿즈", 60000): ["사회적 소비", "적극적 소비"]}
    for (reasons, category, price), tags in want.items():
        df = spark.createDataFrame([(list(reasons), category, price)], "r array<string>, c string, p int")
        assert df.select(selection.inferred_tags(F.lit(None).cast("array<string>"), F.col("r"), F.col("c"), F.col("p"))).first()[0] == tags


def test_panels_are_distinct_and_filled(spark):
    cards = [(i, i, f"Arch_{i % 2}", selection.TAGS[0], float(i % 3)) for i in range(4)]
    df = spark.createDataFrame(cards, "card_id long, ord long, arch string, tag string, coherence double")
    req = spark.createDataFrame([(1, [selection.TAGS[0]], [2]), (2, [selection.TAGS[4]], [])], "request_id long, tags array<string>, favourites array<bigint>")
    got = selection.select(req, df, selection.long_matrix(spark, AFFINITY)).collect()
    for k in (1, 2):
        mine = [r for r in got if r["request_id"] == k]
        assert len({r["card_id"] for r in mine}) == 3 and "opposite" in {r["slot"] for r in mine}
    assert next(r["card_id"] for r in got if r["request_id"] == 1 and r["slot"] == "favourite") == 2


def test_greedy_groups(spark):
    rng = random.Random(3)
    for n in (1, 12, 25):
        edges = {(a, b) for a in range(n) for b in range(n) if a < b and rng.random() < 0.2}
        near = {a: {a} | {y for x, y in edges if x == a} | {x for x, y in edges if y == a} for a in range(n)}
        taken, want = set(), {}
        for a in range(n):
            if a not in taken:
                want[a] = near[a]
                taken |= near[a]
        items = spark.createDataFrame([(i,) for i in range(n)], "vec_id long")
        pairs = spark.createDataFrame([p for a, b in edges for p in ((a, b), (b, a))], "a long, b long")
        got: dict = {}
        for r in grouping.groups(items, pairs, "vec_id").collect():
            got.setdefault(r["head"], set()).add(r["id"])
        assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿uuid,primary_tag,secondary_tag,coherence_score\na,x,,2\n", encoding="utf-8")
    row = tables.csv(spark, str(tmp_path / "t.csv"), tables.SCORED_TAGS).first()
    assert tuple(row) == ("a", "x", None, "2")
    (tmp_path / "c.json").write_text('[{"uuid": "u", "labels": {"archetype": "Arch_0", "primary_tag": "t"}, "profile": {"name": "n"}}]', encoding="utf-8")
    card = tables.mentor_cards(spark, str(tmp_path / "c.json")).first()
    assert (card["uuid"], card["arch"], card["tag"], card["summary"]) == ("u", "Arch_0", "t", None)
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    chunk = F.floor(F.col("id") / 4)
    tables.write_chunks(df, str(tmp_path / "chunks"), chunk, set(), lambda d: d.where("chunk < 2"))
    done = tables.chunks_done(spark, str(tmp_path / "chunks"))
    tables.write_chunks(df, str(tmp_path / "chunks"), chunk, done, lambda d: d)
    assert done == {0, 1} and spark.read.parquet(str(tmp_path / "chunks")).count() == 10
    assert tables.batch_sizes(10, 100, 450, 5) == [4, 4, 2] and not tables.admitted(3, 0, 1) and tables.admitted(2, 0, 1)
    lines = tables.request_lines(df.withColumn("ord", F.col("id")), F.struct("x"), offset=5)
    assert '"custom_id":"req-5"' in lines.first()[0]
    parsed = tables.parsed_results(spark.createDataFrame([('{"a": 2}',), ("bad",)], "j string"), "j", ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in parsed] == [(2.0, 0.0), (0.0, 0.0)]


def test_stream_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).write.mode("append").parquet(src)
        score_new_files(spark, src, spark.range(1).schema, lambda d: d.withColumn("y", F.col("id") + 1), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == 5 * (k + 1)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b", None, ["x", "y"]), (2, "a b", "c", [])], "i int, s string, t string, l array<string>")
    a = encode.encoded_columns(df, ["s", "t"], lambda: encode.HashingEncoder(8))
    b = encode.encoded_columns(df, ["t", "s"], lambda: encode.HashingEncoder(8))
    assert len(a.first()["embedding"]) == 16
    encode.check_columns(a, a)
    with pytest.raises(ValueError):
        encode.check_columns(a, b)
    got = {r["i"]: r["embeddings"] for r in encode.encoded_items(df, "i", "l", lambda: encode.HashingEncoder(8)).collect()}
    assert len(got[1]) == 2 and got[2] == []
