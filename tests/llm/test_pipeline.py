"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mosaiq.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402
from mosaiq.llm import mixing, queries, simhash  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(90_000, None, "en", "src0", 0), (90_001, "123 !!", "en", "src0", 7), (90_002, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, sf_dir).cache()
    assert one.columns == names
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    two = stages["exact_dedup"](spark, one, sf_dir).cache()
    first: dict = {}
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(r["text"].split(" ")) if "\n" not in r["text"] else r["text"].replace("\n", " "), r["doc_id"])
    assert {r["doc_id"] for r in two.collect()} == set(first.values()) and two.columns == names
    three = stages["simhash"](spark, two, sf_dir).cache()
    fps: dict = {}
    for r in sorted(two.collect(), key=lambda r: r["doc_id"]):
        fp = simhash.fingerprint(r["text"])
        if not any((fp ^ x).bit_count() <= 2 for x in fps):
            fps[fp] = r["doc_id"]
    assert {r["doc_id"] for r in three.collect()} <= set(fps.values()) and three.columns == names
    four = stages["mixing"](spark, three, sf_dir).cache()
    planned = {r["row_id"]: len(r["shards"]) for r in mixing.plan(three).collect() if r["shards"]}
    assert Counter(r["doc_id"] for r in four.collect()) == planned and four.columns == names
    five = stages["packing"](spark, four, sf_dir)
    heads = Counter(r["doc_id"] for r in five.where("piece = 0").collect())
    assert heads == planned


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    table = "pages" if name in ("op4_html", "op10_warc") else "embeddings" if name in ("op7_embedding_dedup", "op11_vector_codes") else "documents"
    assert len(got) >= spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = c.execute(queries.ORACLES[name])
        at = sorted(range(len(columns)), key=lambda i: cur.description[i][0])
        assert sorted(str([r[i] for i in at]) for r in cur.fetchall()) == got


def test_names_of_extra_columns_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    assert dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, sf_dir).columns == docs.columns


def test_stages_with_every_name_they_use(spark, sf_dir):
    """Columns that are named as anything the stages name, in any case, pass through with their values."""
    import pathlib
    import re

    folder = pathlib.Path(corpus_pipeline.__file__).parent
    used = set()
    for path in [folder / "corpus_pipeline.py", *(folder / "mosaiq/llm").glob("*.py")]:
        used |= set(re.findall(r"[\"'`](_{0,2}[A-Za-z][A-Za-z0-9_]*)[\"'`.]", path.read_text()))
    used = sorted({u.lower() for u in used} - {"doc_id", "text", "lang", "source", "n_chars"})
    assert {"__id", "__word", "__lang", "__of", "__tag", "shard"} <= set(used)
    extra = [*(u.upper() for u in used), "__key", "__block", "a.b", "c`d"]
    rows = [(i // 2, f"some words of text number {i // 3} and more", "en", f"s{i % 3}", None) for i in range(40)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.select("*", *(F.concat_ws("|", F.lit(c), "doc_id").alias(c) for c in extra)).cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == docs.columns
            assert all(r[c] == f"{c}|{r['doc_id']}" for r in got.collect() for c in extra)
        assert got.count() > 0


def test_a_hot_row_is_no_task_of_its_own(spark):
    """Rows that repeat id and text are aggregated before they are shuffled."""
    hot = spark.range(0, 20_000, numPartitions=6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.col("id").cast("string").alias("note"))
    docs = hot.union(spark.range(100, 200).select("id", F.concat(F.lit("text "), "id"), F.lit("x")))
    got = corpus_pipeline.exact(spark, docs, "")
    assert got.count() == 101 and got.where("doc_id = 7").count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_shards_are_runs_of_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, shards=8)
    by_task = mixed.groupBy(F.spark_partition_id().alias("task")).agg(F.min("shard").alias("low"), F.max("shard").alias("high")).orderBy("task").collect()
    assert all(a["high"] <= b["low"] for a, b in zip(by_task, by_task[1:]))
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixed.count()
    assert len(list((tmp_path / "mix").glob("shard=*"))) == mixed.select("shard").distinct().count()


def test_language_stage_without_labels(spark, sf_dir):
    """Where nothing can be learned, documents with letters stay."""
    docs = spark.createDataFrame([(1, "Some words", None), (2, "12 !", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, sf_dir).collect()} == {1, 4}


@pytest.mark.parametrize("filtered", [True, False])
def test_one_row_of_each_stays(spark, monkeypatch, filtered):
    """Null and repeated ids, repeated rows and clashing names, by the map-side filter and without it."""
    from mosaiq.llm import _common

    monkeypatch.setattr(_common, "MAX_FILTER_IDS", 1 << 22 if filtered else 0)
    a, b, c = "one two three four", "five six seven eight nine", "ten eleven twelve"
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, c), (8, "x y z"), (8, "x y z"), (9, "x  y z"), (10, None), (11, ""), (12, "alone here now")]
    df = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, n int").withColumn("keep", F.lit(1)).withColumn("tag", F.lit("t")).withColumn("row_id", F.lit(0))
    stages = dict(corpus_pipeline.STAGES)
    got = stages["exact_dedup"](spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (None, c), (8, "x y z"), (10, None), (12, "alone here now")], key=str)
    got = stages["simhash"](spark, df, "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (7, c), (8, "x y z"), (10, None), (12, "alone here now")], key=str)


def test_every_stage_on_awkward_tables(spark):
    """Nulls in any column, repeated rows and ids, very long and empty texts, clashing names, empty tables."""
    rows = [(1, "ein Haus und ein Garten", "de", "a", 3), (1, "ein Haus und ein Garten", "de", "a", 3), (1, "a house and a garden", "en", None, None), (None, "a house and a tree", None, "b", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", "b", 150_000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["row_id", "keep", "tag", "shard", "turn", "key", "block", "lang_pred", "score", "piece", "length"]
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            got = stage(spark, docs, "")
            assert (got.columns == df.columns) == (name != "packing")
            assert (got.count() > 0) == (docs is df)
    words = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.language(spark, df, "").collect())
    assert sum(words.values()) == 5 and words[1, "ein Haus und ein Garten"] == 2
    pieces = corpus_pipeline.pack(spark, df, "").collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in rows)
