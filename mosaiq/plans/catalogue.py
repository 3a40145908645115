"""The registered queries: each operator on the tables at hand, with the same result in SQL where SQL can express it.

Vectors are ``embeddings``, texts ``documents`` and ``conversations``. Doubles are rounded
to six places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import encode
from mosaiq.functions import text as T
from mosaiq.functions import vectors as V
from mosaiq.operators import batches, cluster, diversity, grouping, joins, labels, lloyd, lowrank, ordered, projection, prompts, sampling, scoring, selection, simjoin, stats, topk, trials
from mosaiq.plans import oracles
from mosaiq.plans.constants import AFFINITY, ANSWERS, SCENARIOS
from mosaiq.runtime import scratch
from mosaiq.sources import tables
from mosaiq.streaming import centroids as streamed

DIM, K, LABELS = 64, 5, 10
#: Cells of the coarse index, and how many of them a search looks into: these vectors hardly cluster, so a recall of 0.9 takes most cells (4 give 0.54).
RECALL, NEAR = 0.95, 10
LLOYD_KS, LLOYD_STARTS, LLOYD_ROUNDS = (3, 5, 8), (1, 2), 2
#: Buckets of the fitted encoder's terms; tokens and requests in a batch job at most.
TERM_BUCKETS, TOKEN_CAP, REQUEST_CAP = 1 << 14, 20_000, 200
VALUES = ["functional", "emotional", "social", "epistemic", "ethical"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings")


def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    return _emb(spark, sf_dir).select("vec_id", _r6(V.norm(e)).alias("norm"), _r6(V.norm(V.normalise(e))).alias("unit_norm"), _r6(V.norm(V.normalise(e, added=True))).alias("unit_norm_added"))


def exact_topk(spark, sf_dir):
    e = _emb(spark, sf_dir)
    found = topk.batch_search(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return found.select("query_id", "vec_id", "rank", _r6("score").alias("score"))


def _queries(spark, sf_dir) -> DataFrame:
    """Every twentieth vector, as a query against all."""
    return _emb(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def topk_excluding(spark, sf_dir):
    """Each query with three ids of its own that do not count."""
    q = _queries(spark, sf_dir)
    apart = q.select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + 4, F.col("query_id") + 6)).alias("vec_id"))
    found = topk.batch_search(_emb(spark, sf_dir), q, 10, skip_self=False, exclude=apart)
    return found.select("query_id", "vec_id", "rank", _r6("score").alias("score"))


def ivf_topk(spark, sf_dir):
    """A search into as many cells as found enough of the exact results for a sample of the queries."""
    q, index = _queries(spark, sf_dir), topk.CellIndex(_emb(spark, sf_dir))
    return index.search(q, 10, index.probes_for(q, 10, RECALL)).select("query_id", "vec_id", "rank", _r6("score").alias("score"))


def _loaded(spark, sf_dir) -> topk.CellIndex:
    path = scratch(spark)
    topk.CellIndex(_emb(spark, sf_dir)).save(path)
    return topk.CellIndex.load(spark, path)


def ivf_exact(spark, sf_dir):
    """The exact results by an index that was saved and loaded: an eighth of the cells, and those that their radius does not rule out."""
    index = _loaded(spark, sf_dir)
    return index.search_exact(_queries(spark, sf_dir), 10, max(1, len(index.centres) // 8), copy=0).select("query_id", "vec_id", "rank", _r6("score").alias("score"))


def ivf_recall(spark, sf_dir):
    """An index that was saved and loaded finds nine tenths of the exact results at least, with their scores."""
    e, q, index = _emb(spark, sf_dir), _queries(spark, sf_dir), _loaded(spark, sf_dir)
    found = index.search(q, 10, index.probes_for(q, 10, RECALL))
    exact = topk.batch_search(e, q, 10).select("query_id", "vec_id", F.col("score").alias("s"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("score").isNotNull().cast("double")) >= 0.9).alias("recall_ok"), F.max(F.coalesce(F.abs(F.col("score") - F.col("s")) > 1e-9, F.lit(False))).alias("scores_differ"))


def neighbour_graph(spark, sf_dir):
    """Every vector's nearest ones by angle, exactly, as a graph with fuzzy weights."""
    near = projection.neighbours(_emb(spark, sf_dir), DIM, NEAR)
    return projection.neighbour_graph(near, NEAR).select("a", "b", _r6("weight").alias("weight"))


def neighbour_projection(spark, sf_dir):
    """Every vector's place in the plane."""
    place = F.col("place")
    return projection.project(_emb(spark, sf_dir), DIM, NEAR).select("vec_id", _r6(place[0]).alias("x"), _r6(place[1]).alias("y"))


def cluster_centroids(spark, sf_dir):
    e = _emb(spark, sf_dir)
    by = labels.centroids(e, "label", "embedding", DIM).withColumnRenamed("centroid", "v").select(F.col("label").cast("string").alias("label"), "v", "n")
    every = labels.overall_mean(e, "embedding", DIM).crossJoin(e.agg(F.count(F.lit(1)).alias("n"))).select(F.lit("ALL").alias("label"), F.col("mean").alias("v"), "n")
    return by.union(every).select("label", "n", F.posexplode("v").alias("pos", "x")).select("label", "n", "pos", _r6("x").alias("x"))


def _sims(spark, sf_dir, shift: int = 0) -> DataFrame:
    """Anchors are the first vector of each label, named in another order if ``shift`` asks for it."""
    e = _emb(spark, sf_dir)
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(((F.col("label") + shift) % LABELS).alias("anchor"), "vector")
    clusters = labels.centroids(e, "label", "embedding", DIM).select(F.col("label").alias("cluster"), "centroid")
    return labels.similarity_matrix(anchors, clusters, labels.overall_mean(e, "embedding", DIM))


def anchor_similarity_matrix(spark, sf_dir):
    return _sims(spark, sf_dir).select("anchor", "cluster", _r6("sim").alias("sim"))


def optimal_assignment(spark, sf_dir):
    return labels.assign(_sims(spark, sf_dir, 2)).select("anchor", "cluster", _r6("sim").alias("sim"))


def assignment_margins(spark, sf_dir):
    return labels.margins(_sims(spark, sf_dir)).select("anchor", _r6("margin").alias("margin"), "low_conf")


def assignment_quality(spark, sf_dir):
    sims = _sims(spark, sf_dir)
    return labels.assignment_quality(labels.assign(sims), labels.margins(sims)).select(*(_r6(c).alias(c) for c in ("min_cos", "mean_cos", "min_margin")))


def cluster_medoids(spark, sf_dir):
    return labels.medoids(_emb(spark, sf_dir), "label", "vec_id", "embedding", DIM, 3).select("label", "vec_id", "rank", _r6("distance").alias("distance"))


def medoid_and_others(spark, sf_dir):
    return labels.medoid_and_others(_emb(spark, sf_dir), "label", "vec_id", "embedding", DIM, 4).select("label", "vec_id", "rank")


def entropy_noise(spark, sf_dir):
    e = _emb(spark, sf_dir)
    found = labels.noise_by_entropy(e, "embedding", labels.centroids(e, "label", "embedding", DIM), carry=["vec_id"])
    return found.select("vec_id", _r6("entropy").alias("entropy"), "noise_dist")


def crosstab_all(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    return stats.crosstab(docs.join(marks, "doc_id"), "lang", "quality", docs, spark.range(3).select(F.col("id").cast("int").alias("quality")))


def crosstab_clean(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = _read(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality")
    return stats.crosstab(docs.join(marks, "doc_id"), "lang", "quality", docs, marks)


def value_shares(spark, sf_dir):
    return stats.value_shares(_read(spark, sf_dir, "documents"), "source", 20).select("source", "n", _r6("share").alias("share"))


def cluster_imbalance(spark, sf_dir):
    sizes = _emb(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return stats.imbalance(sizes).select(*(_r6(c).alias(c) for c in ("max_share", "min_share", "balance")), "too_large", "too_small")


def _values(spark, sf_dir) -> DataFrame:
    """Five values of a row: the first components of its vector, moved to be positive."""
    return _emb(spark, sf_dir).select("vec_id", "label", *((F.col("embedding")[i].cast("double") * 4 + 4).alias(c) for i, c in enumerate(VALUES)))


def _value_centres(spark) -> DataFrame:
    rows = [(f"type{i}", *(5.0 if i == j else 2.0 + 0.25 * j for j in range(K))) for i in range(K)]
    return spark.createDataFrame(rows, "type string, " + ", ".join(f"{c} double" for c in VALUES))


def centroid_rescale(spark, sf_dir):
    return labels.rescaled_centroids(_value_centres(spark), _values(spark, sf_dir), VALUES).select("type", *(_r6(c).alias(c) for c in VALUES))


def top2_types(spark, sf_dir):
    values = _values(spark, sf_dir)
    centres = labels.rescaled_centroids(_value_centres(spark), values, VALUES).select("type", F.array(*VALUES).alias("centroid"))
    return labels.top2_types(values, F.array(*VALUES), centres, ["vec_id"], 0.97).select("vec_id", "type1", "type2", _r6("top1_sim").alias("top1_sim"), _r6("top2_sim").alias("top2_sim"))


def _anchor_raw(spark, sf_dir) -> DataFrame:
    """The three vectors nearest to a label's mean are its anchors."""
    e = _emb(spark, sf_dir)
    anchors = _typical(e, 3).select(F.col("label").alias("anchor_group"), F.col("embedding").alias("anchor_vector"))
    return scoring.anchor_max(e, anchors, "vec_id", "embedding")


def _typical(e: DataFrame, n: int) -> DataFrame:
    """The ``n`` vectors nearest to each label's mean: some rows a label, whatever the table's size."""
    return e.join(F.broadcast(labels.medoids(e, "label", "vec_id", "embedding", DIM, n).select("vec_id")), "vec_id", "left_semi")


def anchor_max_scaled(spark, sf_dir):
    raw = _anchor_raw(spark, sf_dir)
    scored = scoring.clip_scaled(raw, "raw", scoring.pooled_percentiles(raw, "raw"))
    return scored.select("vec_id", "anchor_group", _r6("raw").alias("raw"), _r6("score").alias("score"))


def _neighbours(spark, sf_dir) -> DataFrame:
    e = _emb(spark, sf_dir)
    hobbies = _typical(e, 10).select(F.col("vec_id").alias("h"), F.col("embedding").alias("hv"), (F.col("vec_id") % 6).cast("double").alias("functional"), (F.col("vec_id") % 4).cast("double").alias("social"))
    sims = e.crossJoin(F.broadcast(hobbies)).where("vec_id <> h").select("vec_id", "functional", "social", V.cosine(F.col("embedding"), F.col("hv")).alias("sim"))  # ten rows a label
    return scoring.weighted_neighbours(sims, ["functional", "social"], "vec_id", e, 0.25)


def weighted_knn_score(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", _r6("functional").alias("functional"), _r6("social").alias("social"))


def score_fusion(spark, sf_dir):
    values = _values(spark, sf_dir).select("vec_id", F.col("functional").alias("f"), F.col("social").alias("s"))
    both = _neighbours(spark, sf_dir).join(values, "vec_id")
    valid = F.col("functional") + F.col("social") > 0
    return both.select("vec_id", _r6(scoring.fused(F.col("functional"), F.col("f"), valid, 0.5, 1.5)).alias("functional"), _r6(scoring.fused(F.col("social"), F.col("s"), valid, 0.5, 1.5)).alias("social"))


def structural_noise(spark, sf_dir):
    """The four blocks of a vector stand for four columns' vectors."""
    e, wide = _emb(spark, sf_dir), DIM // 4
    means = labels.overall_mean(e, "embedding", DIM)
    rows = e.crossJoin(F.broadcast(means))  # one row
    parts = [V.block(F.col("embedding"), i, wide) for i in range(4)]
    away = [V.euclidean(p, V.block(F.col("mean"), i, wide)) for i, p in enumerate(parts)]
    centre = V.scale(V.add(V.add(parts[0], parts[1]), V.add(parts[2], parts[3])), F.lit(0.25))
    spread = [V.total(F.transform(V.subtract(p, centre), lambda x: x * x)) for p in parts]
    signals = rows.select("vec_id", ((away[0] + away[1] + away[2] + away[3]) / 4).alias("distinct"), V.norm(centre).alias("emb_norm"), (V.total(F.array(*spread)) / 4 / wide).alias("consistency"))
    found = labels.consensus_noise(signals, {"distinct": "low", "emb_norm": "high", "consistency": "low"}, 0.2)
    return found.select("vec_id", _r6("distinct").alias("distinct"), _r6("emb_norm").alias("emb_norm"), _r6("consistency").alias("consistency"), "flags", "noise_struct")


def quota_sample(spark, sf_dir):
    """Customers by band of their balance, the last band left out."""
    band = F.when(F.col("c_acctbal") < 0, "a").when(F.col("c_acctbal") < 1000, "b").when(F.col("c_acctbal") < 6000, "c").otherwise("other")
    return sampling.quota_sample(_read(spark, sf_dir, "customer"), 500, band, "c_custkey").select("c_custkey", "stratum")


def stratified_sample(spark, sf_dir):
    """As quota_sample, without passing on what small bands leave."""
    return sampling.quota_sample(_read(spark, sf_dir, "customer"), 500, F.col("c_mktsegment"), "c_custkey", excluded=("MACHINERY",), carry=False).select("c_custkey", "stratum")


def exact_hash_sample(spark, sf_dir):
    return sampling.exact_sample(_read(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


def keep_first(spark, sf_dir):
    return stats.keep_first(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["text"], ["doc_id"]).select("doc_id", "source")


def stat_bundle(spark, sf_dir):
    return stats.bundle_by(_read(spark, sf_dir, "events"), "event_type", "value").select("event_type", *(_r6(c).alias(c) for c in ("mean", "p50", "p95", "min", "max")), "n")


def trial_rates(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where("value IS NOT NULL")
    passed = F.avg((F.col("value") >= 25).cast("double"))
    users = e.groupBy("user_id").agg(passed.alias("pass_rate"), F.count_distinct("event_type").alias("k"))
    return users.select("user_id", _r6("pass_rate").alias("pass_rate"), (F.col("k") == 3).alias("three_types"))


def threshold_loss_curve(spark, sf_dir):
    values = _values(spark, sf_dir)
    centres = labels.rescaled_centroids(_value_centres(spark), values, VALUES).select("type", F.array(*VALUES).alias("centroid"))
    best = labels.top2_types(values, F.array(*VALUES), centres, ["vec_id"], -1.0)
    return stats.loss_curve(best, "top1_sim", [round(0.80 + 0.01 * i, 2) for i in range(19)]).select(_r6("threshold").alias("threshold"), _r6("share").alias("share"))


def token_stats(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.col("text"))).cast("double").alias("tokens"))
    found = stats.bundle_by(rows, "lang", "tokens", shares={"p50": 0.5, "p95": 0.95, "p99": 0.99}, over=512)
    return found.select("lang", *(_r6(c).alias(c) for c in ("mean", "p50", "p95", "p99", "min", "max", "over")), "n")


def _answers(spark, sf_dir) -> DataFrame:
    """All turns of the assistant, in order."""
    return _read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("ordinal"), "text")


def lexical_diversity(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    found = diversity.report(rows, diversity.lexical(rows, "conv_id", "ordinal", "text"), "conv_id")
    return found.select("conv_id", "n_pairs", _r6("mean_score").alias("mean_score"), "passed", "worst_i", "worst_j")


def ngram_counts(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    return diversity.word_counts(rows, ["conv_id"], "text", 2)


def embedding_diversity(spark, sf_dir):
    rows = _emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("grp"), (F.col("vec_id") % 3).alias("ordinal"), "embedding")
    found = diversity.report(rows, diversity.by_vectors(rows, "grp", "ordinal", "embedding"), "grp")
    return found.select("grp", "n_pairs", _r6("mean_score").alias("mean_score"), "passed", "worst_i", "worst_j")


def scorer_ablation(spark, sf_dir):
    rows = _emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("grp"), (F.col("vec_id") % 3).alias("ordinal"), "embedding")
    parts = {"first": F.slice("embedding", 1, 32), "second": F.slice("embedding", 33, 32), "all": F.col("embedding")}
    each = [diversity.by_vectors(rows.withColumn("v", v), "grp", "ordinal", "v").withColumn("model", F.lit(k)) for k, v in parts.items()]
    found = diversity.compare_scorers(each[0].unionByName(each[1]).unionByName(each[2]), "model", "grp")
    return found.select("model", *(_r6(c).alias(c) for c in ("mean", "median", "min", "max")), "n")


def response_postprocess(spark, sf_dir):
    p = T.postprocess(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", p["text"].alias("text"), p["is_valid"].alias("is_valid"), F.length(p["text"]).cast("long").alias("n_chars"))


def retry_gate(spark, sf_dir):
    """Turns of a conversation stand for the attempts of two slots."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), (F.col("turn") % 2).cast("int").alias("slot"), F.floor(F.col("turn") / 2).cast("int").alias("attempt"), "text")
    return diversity.gate(turns).select("request", "slot", "attempt", "is_valid", _r6("mean_score").alias("mean_score"), "passed")


def prefix_saturation(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return stats.prefix_saturation(docs, words, "doc_id", "word", [100, 200, 300, 400, 500]).select("prefix", "n_unique", _r6("growth").alias("growth"), "saturated")


def _scenarios(spark, sf_dir) -> DataFrame:
    """Each part as a purchase that somebody asks about: a category, up to two reasons, an item and a price."""
    key = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, oracles.CATEGORIES)), (key % len(oracles.CATEGORIES) + 1).cast("int"))
    reasons = F.slice(F.array(*map(F.lit, oracles.REASONS)), (key % (len(oracles.REASONS) - 1) + 1).cast("int"), (key % 3).cast("int"))
    price = F.floor(F.col("p_retailprice").cast("double") * F.col("p_size")).cast("int")
    return _read(spark, sf_dir, "part").select(key.cast("string").alias("request_id"), category.alias("category"), reasons.alias("reasons"), F.col("p_name").alias("item"), price.alias("price"))


def tag_inference(spark, sf_dir):
    tags = selection.inferred_tags(F.lit(None).cast("array<string>"), F.col("reasons"), F.col("category"), F.col("price"))
    block = selection.context_block(F.col("reasons"), F.col("item"), F.col("category"), F.col("price"), F.lit(""))
    query = selection.context_query(F.col("reasons"), F.col("item"), F.col("category"), F.lit(""))
    return _scenarios(spark, sf_dir).select("request_id", F.array_join(tags, ",").alias("tags"), query.alias("query"), block.alias("block"))


def affinity_scores(spark, sf_dir):
    tags = selection.inferred_tags(F.lit(None).cast("array<string>"), F.col("reasons"), F.col("category"), F.col("price"))
    scores = selection.affinity(_scenarios(spark, sf_dir).select("request_id", tags.alias("tags")), selection.long_matrix(spark, AFFINITY))
    return scores.select("request_id", "arch", "score")


def _panel_inputs(spark, sf_dir):
    e = _emb(spark, sf_dir)
    tag = F.element_at(F.array(*map(F.lit, selection.TAGS)), (F.floor(F.col("vec_id") / 5) % 5 + 1).cast("int"))
    arch = F.concat(F.lit("Arch_"), (F.col("vec_id") % 5).cast("string"))
    cards = e.select(F.col("vec_id").alias("card_id"), F.col("vec_id").alias("ord"), arch.alias("arch"), tag.alias("tag"), (F.col("vec_id") % 3).cast("double").alias("coherence"), F.col("embedding").alias("vector"))
    tags = F.array(F.element_at(F.array(*map(F.lit, selection.TAGS)), (F.col("vec_id") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, selection.TAGS)), (F.floor(F.col("vec_id") / 7) % 5 + 1).cast("int")))
    favourites = F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(-1).cast("bigint"), F.col("vec_id") + 1))
    requests = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("request_id"), tags.alias("tags"), favourites.alias("favourites"), F.col("embedding").alias("vector"))
    return requests, cards


def mentor_selection(spark, sf_dir):
    requests, cards = _panel_inputs(spark, sf_dir)
    hits = selection.search_hits(requests, cards)
    return selection.select(requests, cards, selection.long_matrix(spark, AFFINITY), hits)


def mentor_selection_reliable(spark, sf_dir):
    requests, cards = _panel_inputs(spark, sf_dir)
    return selection.select(requests, cards, selection.long_matrix(spark, AFFINITY))


def greedy_dedupe(spark, sf_dir):
    items = _emb(spark, sf_dir)
    grouped = grouping.greedy_groups(items, "vec_id", "embedding", 0.3, "label")
    chosen = grouping.representatives(grouped, items, "vec_id", "embedding", DIM)
    return grouping.aliases(grouped, chosen).select(F.col("id").alias("vec_id"), "representative")


def threshold_join(spark, sf_dir):
    """All pairs of similar vectors, whatever their labels; equal vectors as one."""
    found = simjoin.threshold_pairs(_emb(spark, sf_dir), "vec_id", "embedding", 0.4)
    return found.select("a", "b", _r6("sim").alias("sim"), "a_copies", "b_copies")


def fixed_label_quality(spark, sf_dir):
    q = stats.cluster_quality(_emb(spark, sf_dir), "label", "embedding", DIM)
    return q.select("k", "n", _r6("davies_bouldin").alias("davies_bouldin"), _r6("calinski_harabasz").alias("calinski_harabasz"))


def sampled_silhouette(spark, sf_dir):
    sample = sampling.exact_sample(_emb(spark, sf_dir), 5000, "vec_id")
    return stats.silhouette(sample, "vec_id", "label", "embedding").select(_r6("silhouette").alias("silhouette"))


def label_agreement(spark, sf_dir):
    pairs = _emb(spark, sf_dir).select("label", F.floor((F.col("label") + F.col("vec_id") % 3) / 2).alias("other"))
    return stats.adjusted_rand(pairs, "label", "other").select(_r6("ari").alias("ari"))


def rank_correlation(spark, sf_dir):
    return stats.spearman(_values(spark, sf_dir), VALUES[:3]).select("a", "b", _r6("rho").alias("rho"))


def value_histogram(spark, sf_dir):
    return stats.histogram(_read(spark, sf_dir, "events").where("value IS NOT NULL"), "value", 0.0, 200.0, 20)


def regress_out(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("len", (F.col("vec_id") % 37).cast("double")).withColumn("kind", (F.col("label") % 3).cast("string"))
    return cluster.regress_out(e, "embedding", DIM, ["len"], ["kind"]).select("vec_id", _r6(V.norm(F.col("residual"))).alias("residual_norm"))


def pca_kmeans(spark, sf_dir):
    config = cluster.Config(k=10, starts=3, pca=16)
    return cluster.spherical_pipeline(_emb(spark, sf_dir), "embedding", config).select("vec_id", "cluster")


def bootstrap_ari(spark, sf_dir):
    return spark.createDataFrame([(cluster.bootstrap_ari(_emb(spark, sf_dir), "embedding", "vec_id", k=5, starts=2),)], "ari double")


# Clusters: several runs compared


def _table(spark, rows: list[dict], kind: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], kind)


_QUALITY = "silhouette double, davies_bouldin double, calinski_harabasz double, balance double"


def k_sweep(spark, sf_dir):
    """Quality by number of clusters, and which of them has the best silhouette."""
    rows = cluster.sweep(_emb(spark, sf_dir), "embedding", DIM, "vec_id", range(8, 12), starts=2)
    chosen = cluster.best(rows, "silhouette")
    return _table(spark, [{**r, "best": r is chosen} for r in rows], f"k int, {_QUALITY}, best boolean")


def reduction_comparison(spark, sf_dir):
    return _table(spark, cluster.compare_reductions(_emb(spark, sf_dir), "embedding", DIM, "vec_id", (16, 32), LABELS, starts=2), f"method string, dim int, {_QUALITY}, bootstrap_ari double")


def pca_sweep(spark, sf_dir):
    e = _emb(spark, sf_dir)
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).withColumnRenamed("label", "anchor")
    return _table(spark, cluster.pca_sweep(e, "embedding", DIM, anchors, (8, 16), LABELS, starts=2), "pca int, min_cos double, mean_cos double, min_margin double, balance double")


def weight_grid(spark, sf_dir):
    """Silhouettes by pairs of weights, as a row for each first weight."""
    e = _emb(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))
    grid = _table(spark, cluster.weight_grid(e, "first", "second", "vec_id", k=5), "a double, b double, silhouette double")
    weights = [str(round(0.1 * i, 1)) for i in range(1, 21)]
    return stats.pivoted(grid.select(F.round("a", 1).alias("a"), F.round("b", 1).cast("string").alias("b"), _r6("silhouette").alias("silhouette")), "a", "b", "silhouette", weights)


def lloyd_models(spark, sf_dir):
    """k-means of several numbers of clusters and starts, two rounds from seeds in the order of a hash, all in the same scans."""
    e = _emb(spark, sf_dir)
    models = [lloyd.Model(f"{k}-{s}", lloyd.seeds(e, "embedding", "vec_id", k, s)) for k in LLOYD_KS for s in LLOYD_STARTS]
    rows = [(m.name, i, int(n), float(c.sum()), float((c * c).sum())) for m in lloyd.fit_many(e, ["embedding"], models, LLOYD_ROUNDS, 0.0) for i, (n, c) in enumerate(zip(m.sizes, m.centres))]
    return spark.createDataFrame(rows, "model string, cluster int, n long, total double, square double").select("model", "cluster", "n", _r6("total").alias("total"), _r6("square").alias("square"))


def minibatch_kmeans(spark, sf_dir):
    """Every vector with its cluster after mini-batches over all of them."""
    e = _emb(spark, sf_dir)
    model = lloyd.fit_minibatch(e, "embedding", "vec_id", LABELS, batch_rows=4096)
    return lloyd.assign(e, "embedding", model.centres, distance="distance").select("vec_id", "cluster", _r6("distance").alias("distance"))


def all_row_silhouette(spark, sf_dir):
    """Silhouette by squared distance of all vectors, clustered by the means of the labels."""
    e = _emb(spark, sf_dir)
    means = e.groupBy("label").agg(V.mean_by_position("embedding").alias("m")).orderBy("label").collect()  # a row a label
    model = lloyd.Model("labels", np.array([r["m"] for r in means]))
    score = lloyd.silhouettes(e, ["embedding"], [model])[0]
    return lloyd.assign(e, "embedding", model.centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.round(F.lit(score), 6))


def row_ordinals(spark, sf_dir):
    """Row numbers of all documents by source and id."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return ordered.ordinals(docs, ["source", "doc_id"]).select("doc_id", "ord")


def literal_lists(spark, sf_dir):
    """The words of each turn as Python writes their list, quotes and all, parsed back."""
    words = T.tokens(F.col("text"))
    quoted = F.transform(words, lambda w: F.concat(F.lit("'"), F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    written = F.concat(F.lit("["), F.array_join(F.concat(quoted, F.array(F.lit("None"), F.lit("\"it's\""), F.lit("7"))), ", "), F.lit("]"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.list_or_string(written).alias("items"))
    return rows.select("conv_id", "turn", F.size("items").cast("long").alias("n"), F.array_join("items", "|").alias("items"))


def spherical_kmeans(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", V.normalise(F.col("embedding")).alias("u"))
    centres, _ = cluster.spherical_kmeans(e, "u", "vec_id", LABELS)
    return cluster.by_cosine(e, "u", centres).select("vec_id", "cluster", _r6("sim").alias("sim"))


def explained_variance(spark, sf_dir):
    """Shares of the variance by principal component, and how many components explain nine tenths; all of them explain all."""
    shares = cluster.pca(_emb(spark, sf_dir), "embedding", DIM)[1]
    rows = [(len(shares), bool(abs(shares.sum() - 1) < 1e-9), bool((shares[:-1] >= shares[1:] - 1e-12).all()), bool(shares[: cluster.components_for(shares, 0.9)].sum() >= 0.9))]
    return spark.createDataFrame(rows, "components int, sums_to_one boolean, descending boolean, enough boolean")


def encoded_texts(spark, sf_dir):
    """Two text columns encoded by themselves and joined; each part has unit length, or is zero where there are no words."""
    rows = encode.encoded_columns(_read(spark, sf_dir, "documents").select("doc_id", "text", F.nullif("source", F.lit("src0")).alias("source")), ["text", "source"], lambda: encode.HashingEncoder(32))
    part = lambda i: F.round(V.norm(V.block(F.col("embedding"), i, 32)), 4)
    return rows.select("doc_id", F.size("embedding").cast("long").alias("dim"), part(0).alias("text_norm"), part(1).alias("source_norm"))


def encoded_lists(spark, sf_dir):
    """Lists of words, a vector each; empty lists stay."""
    items = F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 3)
    rows = encode.encoded_items(_read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), items.alias("items")), "id", "items", lambda: encode.HashingEncoder(16))
    return rows.select("id", F.size("embeddings").cast("long").alias("n"), F.coalesce(F.round(F.array_max(F.transform("embeddings", V.norm)), 4), F.lit(0.0)).alias("norm"))


def clusters_hold(spark, sf_dir):
    """What every run must fulfil: residuals without a trace of the covariates, rows nearest to their own centroid, agreement within its bounds."""
    e = _emb(spark, sf_dir).withColumn("len", (F.col("vec_id") % 37).cast("double")).withColumn("kind", (F.col("label") % 3).cast("string"))
    left = cluster.regress_out(e, "embedding", DIM, ["len"], ["kind"])
    traces = left.select("residual", F.posexplode(F.array(F.lit(1.0), F.col("len"), (F.col("kind") == "1").cast("double"))).alias("i", "x"))
    trace = traces.select("i", V.scale(F.col("residual"), F.col("x")).alias("t")).groupBy("i").agg(V.sum_by_position("t").alias("t"))
    trace = trace.agg(F.max(F.array_max(F.transform("t", F.abs))).alias("most"))
    runs = cluster.spherical_pipeline(_emb(spark, sf_dir), "embedding", cluster.Config(k=LABELS, starts=3, pca=16))
    agreed = stats.adjusted_rand(runs, "cluster", "label")
    sizes = runs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k"), F.max(F.abs(V.norm(F.col("projected")) - 1)).alias("off"))
    return trace.crossJoin(agreed).crossJoin(sizes).select(
        (F.col("most") < 1e-6).alias("no_trace"), F.col("ari").between(-1, 1).alias("ari_in_bounds"), (F.col("off") < 1e-9).alias("unit"), "n", F.col("k").alias("clusters")
    )


def randomised_pca(spark, sf_dir):
    """What two directions found by two rounds from fixed signs leave of each vector: its squared distance from what they restore."""
    e = _emb(spark, sf_dir)
    found = lowrank.components(e, "embedding", DIM, 2, extra=0, rounds=2)
    captured = float(found.variances.sum() / found.total)
    return found.project(e, "embedding").select("vec_id", _r6("residual").alias("residual"), F.round(F.lit(captured), 6).alias("captured"))


def fitted_encoder(spark, sf_dir):
    """Documents as points in the leading subspace of their weighted terms, fitted on all of them: each point's squared length."""
    counted = lowrank.count_terms(_read(spark, sf_dir, "documents"), "text", TERM_BUCKETS, ["doc_id"])
    model = lowrank.fit_counted(counted, 2, TERM_BUCKETS, extra=0, rounds=2)
    return lowrank.placed(counted, model, ["doc_id"], "v").select("doc_id", _r6(V.dot(F.col("v"), F.col("v"))).alias("kept"))


def label_residuals(spark, sf_dir):
    """Vectors less what their label explains: the residuals' norms, first and last component."""
    left = cluster.regress_out(_emb(spark, sf_dir).withColumn("kind", F.col("label").cast("string")), "embedding", DIM, [], ["kind"])
    part = lambda i: _r6(F.get("residual", F.lit(i)))
    return left.select("vec_id", _r6(V.norm(F.col("residual"))).alias("residual_norm"), part(0).alias("first"), part(DIM - 1).alias("last"))


def component_variances(spark, sf_dir):
    """The variance of all vectors, from that of their components along all principal directions."""
    found = lowrank.components(_emb(spark, sf_dir), "embedding", DIM, DIM, extra=0, rounds=1)
    return spark.createDataFrame([(len(found.variances), float(found.variances.sum()), float((found.variances**2).sum()))], "n int, total double, square double").select(F.col("n").cast("long").alias("n"), _r6("total").alias("total"), _r6("square").alias("square"))


def incremental_centroids(spark, sf_dir):
    """Means by label of files that arrive one by one, each a micro-batch; taken up again after the first run."""
    top = scratch(spark)
    e = _emb(spark, sf_dir).select("label", "embedding")
    for run in range(2):
        e.where(F.pmod(F.xxhash64("embedding"), F.lit(2)) == run).write.mode("append").parquet(f"{top}/in")
        streamed.sum_new_files(spark, f"{top}/in", e.schema, "label", "embedding", f"{top}/sums", f"{top}/log", 1).awaitTermination()
    found = streamed.merged(spark, f"{top}/sums")
    return found.select("cluster", "n", F.posexplode("centroid").alias("pos", "x")).select("cluster", "n", "pos", _r6("x").alias("x"))


def request_batches(spark, sf_dir):
    """Documents as requests of a token a word and fifty for the prompt, cut into batch jobs."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("words"))
    return batches.cut(docs, ["doc_id"], F.col("words") + 50, TOKEN_CAP, REQUEST_CAP).select("doc_id", "tokens", "batch", "place")


def collected_answers(spark, sf_dir):
    """The conversations' turns as answers of batch jobs, one a conversation modulo 50, of which some failed; the first answer of each text counts."""
    turns = _read(spark, sf_dir, "conversations")
    answers = turns.select("text", (F.col("conv_id") % 50).alias("batch"), "conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.lit("refused")).alias("error"))
    jobs = turns.select((F.col("conv_id") % 50).alias("batch")).distinct().withColumn("status", F.when(F.col("batch") % 7 == 3, "failed").otherwise("completed"))
    return batches.collected(answers, jobs, "text", ["batch", "conv_id", "turn"]).select("text", "batch", "conv_id", "turn")


# Tables in and out


def csv_round_trip(spark, sf_dir):
    customers, path = _read(spark, sf_dir, "customer"), scratch(spark)
    tables.write_csv(customers, path)
    return tables.csv(spark, path, customers.schema)


def parquet_rolled(spark, sf_dir):
    """Files rolled by rows; a second write finds them there and leaves them."""
    customers, path = _read(spark, sf_dir, "customer"), scratch(spark)
    tables.write_parquet(customers, path, rows_per_file=400)
    tables.write_parquet(customers.limit(0), path, exists="ignore")
    return tables.parquet(spark, path, "c_custkey", "c_name")


def json_array(spark, sf_dir):
    """JSON documents that hold a list of up to 1,000 objects each, some of their fields asked for."""
    path = scratch(spark)
    objects = F.collect_list(F.struct(F.col("request_id").alias("id"), "item", "price", F.col("reasons").alias("tags")))
    lists = _scenarios(spark, sf_dir).groupBy(F.floor(F.col("request_id").cast("long") / 1000).alias("chunk")).agg(F.to_json(objects).alias("value"))
    lists.write.partitionBy("chunk").text(path)
    return tables.json_documents(spark, path, "id string, item string, price int, missing string").drop("chunk")


def key_equality(spark, sf_dir):
    """Whether two tables have the same ids, in whatever order."""
    docs, marks = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id")
    found = (joins.same_keys(docs, docs.orderBy(F.desc("doc_id")), "doc_id"), joins.same_keys(docs, marks, "doc_id"), joins.same_keys(marks, docs, "doc_id"))
    return spark.createDataFrame([found], "reordered boolean, fewer boolean, more boolean")


def affinity_tag_major(spark, sf_dir):
    """The same scores from a matrix that is given by tag, within a wrapper."""
    tags = selection.inferred_tags(F.lit(None).cast("array<string>"), F.col("reasons"), F.col("category"), F.col("price"))
    turned = {"matrix": {t: {a: row[t] for a, row in AFFINITY.items()} for t in selection.TAGS}}
    return selection.affinity(_scenarios(spark, sf_dir).select("request_id", tags.alias("tags")), selection.long_matrix(spark, turned)).select("request_id", "arch", "score")


def json_requests(spark, sf_dir):
    """Request lines as a batch job takes them, written and read again."""
    docs, path = _read(spark, sf_dir, "documents"), scratch(spark)
    tables.write_lines(tables.request_lines(docs.withColumn("ord", F.col("doc_id")), F.struct("lang", "n_chars"), offset=1000), path)
    return spark.read.text(path)


def json_mapping(spark, sf_dir):
    """A mapping of labels as one JSON object, and the vectors' labels looked up in it."""
    e, path = _emb(spark, sf_dir), scratch(spark)
    known = e.where("label <> 3").select(F.col("label").alias("key"), F.concat(F.lit("type "), F.col("label")).alias("label")).distinct()
    tables.write_mapping(known, path)
    mapping = tables.read_mapping(spark, path).withColumnRenamed("key", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return labels.mapped(e.select("vec_id", F.col("label").alias("cluster")), mapping, "cluster").select("vec_id", "label")


def resumed_chunks(spark, sf_dir):
    """A job in chunks that was broken off after the first two and taken up again; all chunks read as one table."""
    rows, path = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), scratch(spark)
    chunk = F.floor(F.col("c_custkey") / 100) % 7
    tables.write_chunks(rows, path, chunk, set(), lambda d: d.where("chunk < 2"))
    tables.write_chunks(rows, path, chunk, tables.chunks_done(spark, path), lambda d: d)
    return tables.parquet(spark, path).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), _r6(F.sum("c_acctbal")).alias("total"))


def parsed_properties(spark, sf_dir):
    """Numbers from JSON texts; those that are not there are 0."""
    rows = tables.parsed_results(_read(spark, sf_dir, "events"), "props", ["k", "missing"])
    return rows.select("event_id", "k", "missing")


# Side by side


def score_attach(spark, sf_dir):
    """Scores given as text, some of them no numbers, others missing."""
    marks = _read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "bad").otherwise(F.col("quality").cast("string")).alias("score"))
    return joins.attach_score(_read(spark, sf_dir, "documents").select("doc_id"), marks, "doc_id", "score").select("doc_id", "score")


def score_equal(spark, sf_dir):
    marks = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("score"))
    return joins.equal_to(marks, "score", 1).select("doc_id")


def align_zero_fill(spark, sf_dir):
    ids = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return joins.align(ids, _emb(spark, sf_dir), "vec_id", "embedding", DIM, "zero").select("vec_id", _r6(V.norm(F.col("embedding"))).alias("norm"))


def align_drop(spark, sf_dir):
    ids = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return joins.align(ids, _emb(spark, sf_dir), "vec_id", "embedding", DIM, "drop").select("vec_id", _r6(V.norm(F.col("embedding"))).alias("norm"))


def cached_lookup(spark, sf_dir):
    """A cache that holds all wanted rows is read; one that lacks a row is not."""
    e = _emb(spark, sf_dir).select("vec_id", "label")
    wanted = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")).join(e, "vec_id", "left_semi")
    whole = joins.cached_or_recomputed(wanted, e, "vec_id", lambda w: w.withColumn("label", F.lit(-1)))
    part = joins.cached_or_recomputed(wanted, e.where("vec_id > 50"), "vec_id", lambda w: w.withColumn("label", F.lit(-1)))
    return whole.select("vec_id", F.col("label").cast("long").alias("label"), F.lit(True).alias("cached")).union(part.select("vec_id", F.col("label").cast("long"), F.lit(False)))


def label_merge(spark, sf_dir):
    docs, marks = _read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    merged, lost = joins.merge_labels(docs, marks, "doc_id")
    return merged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("good")).withColumn("lost", F.lit(lost).cast("long"))


def scenario_lookup(spark, sf_dir):
    """What was ordered, looked up in a main list and else in a derived one; some is in both, some in neither."""
    every = _scenarios(spark, sf_dir).select(F.col("request_id").cast("int").alias("id"), "category", "item")
    main, more = every.where("id % 3 <> 0"), every.where("id % 2 = 0").select(F.col("id").cast("string").alias("id"), "category", F.concat(F.lit("derived "), F.col("item")).alias("item"))
    return joins.scenarios(main, more, _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id")))


# Texts


def age_bands(spark, sf_dir):
    age = F.col("p_size") * 2
    return _read(spark, sf_dir, "part").select("p_partkey", T.age_band(age).alias("band"), T.age_band(age, oldest=True).alias("band_70"))


def persona_texts(spark, sf_dir):
    """Parts of a text, some empty or missing, and what a list given as text holds."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = T.tokens(F.col("text"))
    hobbies = T.truthy(words)
    plain = F.regexp_replace(F.array_join(hobbies, " "), "['\"\\[\\],]", "")
    listed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("['"), F.array_join(F.split(plain, " "), "', '"), F.lit("']"))).when(F.col("turn") % 3 == 1, plain)
    text = T.persona_text(F.col("role"), F.when(F.col("turn") % 2 == 0, ""), F.lit(None).cast("string"), F.col("turn").cast("string"), hobbies, F.lit("end"))
    return c.select("conv_id", "turn", text.alias("text"), F.array_join(T.list_or_string(listed), "|").alias("listed"))


def text_tidied(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" \t"), F.col("role"), F.lit("\n ")).alias("role"))
    return joins.tidy(c, ["role"])


def describe_values(spark, sf_dir):
    found = stats.describe(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column", "count", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


def value_pivot(spark, sf_dir):
    sums = _read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return stats.pivoted(sums, "source", "lang", "n", ["en", "fr", "de", "es"])


# Prompts, answers and trials

#: Sections by number, and guides by type; a caller brings its own.
SECTIONS = [
    (1, "# Mentor\nName: {name}\nArchetype: {arch}\nStyle: {style}"), (2, "# Turns\nAnswer what was asked, in two sentences."), (3, "# Form\nOne sign of feeling a turn, no jargon."),
    (4, "# Voice\nI am {name} and speak as {style}."), (5, "# Child\n{child}\n{memories}"), (6, "# Now\n{item} ({category}), {price}"), (7, "# Example\n{{not a name}} {unknown}"), (8, "# Guide of type {type}\n{guide}"),
]
GUIDES = {1: ("calm", "Recall the plan."), 2: ("warm", "Think of the friend."), 3: ("steady", "Ask how long it lasts."), 4: ("sharp", "Count what is left."), 5: ("dreamy", "Ask what is your own.")}


def _panels(spark, sf_dir) -> DataFrame:
    """Panels of three, with the scenario and the repeat that their requests stand for."""
    j = F.floor(F.col("request_id") / 10)
    return mentor_selection_reliable(spark, sf_dir).select("request_id", (j % 7).alias("scenario"), F.floor(j / 7).alias("repeat"), F.col("position").alias("ordinal"), "slot", "card_id", "arch", "tag")


def system_prompts(spark, sf_dir):
    scenes = spark.createDataFrame([(n, c, i, p) for n, (_, c, _, i, p) in enumerate(SCENARIOS[:7])], "scenario long, category string, item string, price int")
    rows = _panels(spark, sf_dir).join(F.broadcast(scenes), "scenario")  # seven rows
    guides = spark.createDataFrame([(k, *v) for k, v in GUIDES.items()], "type int, style string, guide string")
    memories = prompts.bullets(F.array(F.concat(F.lit("saw "), F.col("item")), F.lit(None), F.lit("has a friend")))
    values = {"name": F.concat(F.lit("card "), F.col("card_id")), "arch": F.col("arch"), "child": F.lit("a child of ten"), "memories": memories, "item": F.col("item"), "category": F.col("category"), "price": T.number_mode(F.col("price")), "type": F.col("type")}
    return prompts.system_prompts(rows, SECTIONS, guides, values).select("request_id", "ordinal", "type", "prompt")


def user_prompts(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("said"), "role")
    return prompts.user_prompts(c, "said", "{role}: {said}", "[{role} waits at {turn}]", {"role": F.col("role"), "said": F.col("said"), "turn": F.col("turn")}).select("conv_id", "turn", "user_prompt")


def _answered(spark, sf_dir) -> DataFrame:
    return prompts.table_answers(_panels(spark, sf_dir), spark.createDataFrame(list(ANSWERS.items()), "type int, text string"))


def table_answers(spark, sf_dir):
    return _answered(spark, sf_dir).select("request_id", "ordinal", "type", "text")


def _trials(spark, sf_dir) -> DataFrame:
    times = _panels(spark, sf_dir).groupBy("scenario", "repeat").agg(F.sum(F.col("card_id") % 17).cast("double").alias("t_total"))
    return trials.trial_table(_answered(spark, sf_dir), times)


def trial_table(spark, sf_dir):
    return _trials(spark, sf_dir).select("scenario", "repeat", _r6("diversity").alias("diversity"), "method", "passed", "n_valid", F.array_join(F.col("types").cast("array<string>"), ",").alias("types"), "n_distinct_types", "t_total")


def trial_report(spark, sf_dir):
    found = trials.trial_report(_trials(spark, sf_dir), ["diversity", "t_total"])
    return found.select("scenario", "measure", "n_trials", *(_r6(c).alias(c) for c in ("pass_rate", "distinct_type_rate", "mean", "p50", "p95", "min", "max")))


def results_json(spark, sf_dir):
    rows = _answered(spark, sf_dir)
    scored = diversity.report(rows, diversity.lexical(rows, "request_id", "ordinal", "text"), "request_id")
    return trials.results_json(rows, scored, "request_id", ["scenario", "repeat"], ["slot", "card_id", "tag", "type", "text"])


def prompt_parts(spark, sf_dir):
    """Parts of a prompt from conversation texts: head, keyword, list, type."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = T.tokens(F.col("text"))
    return c.select(
        "conv_id", "turn", T.head_replaced(F.col("text"), {"a": "b"}, "unknown").alias("head"), T.first_keyword(F.col("text"), ["the", "und", "de"], "none").alias("keyword"),
        F.array_join(F.slice(words, 1, 5), ", ").alias("first_words"), T.lookup(F.col("role"), {"user": 1, "assistant": 2}, 0).alias("type"),
        T.labelled({"role": F.col("role"), "turn": F.col("turn").cast("string")}).alias("labelled"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vector_norms, exact_topk, topk_excluding, ivf_topk, cluster_centroids, anchor_similarity_matrix, optimal_assignment, assignment_margins, assignment_quality,
        cluster_medoids, medoid_and_others, entropy_noise, crosstab_all, crosstab_clean, value_shares, cluster_imbalance, centroid_rescale, top2_types,
        anchor_max_scaled, weighted_knn_score, score_fusion, structural_noise, quota_sample, stratified_sample, exact_hash_sample, keep_first, stat_bundle,
        trial_rates, threshold_loss_curve, token_stats, lexical_diversity, ngram_counts, embedding_diversity, scorer_ablation, response_postprocess, retry_gate,
        prefix_saturation, tag_inference, affinity_scores, mentor_selection, mentor_selection_reliable, greedy_dedupe, fixed_label_quality, sampled_silhouette,
        threshold_join, lloyd_models, minibatch_kmeans, all_row_silhouette, row_ordinals, literal_lists,
        randomised_pca, fitted_encoder, label_residuals, component_variances, incremental_centroids, request_batches, collected_answers,
        label_agreement, rank_correlation, value_histogram, regress_out, pca_kmeans, bootstrap_ari, prompt_parts,
        ivf_recall, ivf_exact, neighbour_graph, neighbour_projection, k_sweep, reduction_comparison, pca_sweep, weight_grid, spherical_kmeans, clusters_hold, explained_variance, encoded_texts, encoded_lists,
        csv_round_trip, parquet_rolled, json_array, key_equality, affinity_tag_major, json_requests, json_mapping, resumed_chunks, parsed_properties, score_attach, score_equal, align_zero_fill, align_drop, cached_lookup, label_merge,
        scenario_lookup, age_bands, persona_texts, text_tidied, describe_values, value_pivot, system_prompts, user_prompts, table_answers, trial_table, trial_report, results_json,
    )
}
ORACLES: dict[str, str] = {**oracles.SQL, "system_prompts": oracles.system_prompts(SECTIONS, GUIDES), "request_batches": oracles.request_batches(TOKEN_CAP, REQUEST_CAP), "fitted_encoder": oracles.fitted_encoder(TERM_BUCKETS), "lloyd_models": oracles.lloyd_models(LLOYD_KS, LLOYD_STARTS, LLOYD_ROUNDS)}
