"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources get word targets: shares of all words by weight, none above ``cap`` times the
   source's own words, the excess reshared by weight.
2. Each source's documents are dealt into ``blocks`` blocks by a hash of their ids. A target is
   turned into an exact quota of block draws: whole passes over the source, then a part of
   a pass in a permuted order of the blocks.
3. A binary tree splits the quotas among the output shards. At each node the left half's
   block draws are a multivariate-hypergeometric draw from the node's quotas, source by
   source, so every shard gets a random but exact share and nothing is drawn twice.
4. A shard's draws are a range of its sources' permuted draws; its rows are shuffled
   locally by a hash.

Everything is DataFrame functions. What is gathered, the quotas, has one row per source
and per block (``blocks`` a source at most), however large the corpus is; documents look
their blocks up, which a hash spreads evenly whatever a source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm._common import columns, hash60, unused, word_count, written

#: Weights of the sources in code-point order of their names, repeated in turn.
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 4096
SHARDS = 64
SEED = "42"
#: Rows (sources times blocks) that travel to every executor at most; with more, Spark joins as it sees fit.
MAX_LOOKED_UP = 1 << 20
#: Sources that a row of the tree holds, about, and tasks that split its nodes.
GROUP, TASKS = 256, 16
#: Length of the lists that results are gathered in.
_LIST = 64
#: Terms taken on either side of a hypergeometric distribution's mode, in standard deviations.
_REACH = 12


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, weight, target)``, one row per source, from ``source`` and ``size``.

    Sources in ascending order of ``cap * size / weight`` reach their caps first; with the
    caps of the first k taken out, the rest share by weight. The first k whose share does
    not exceed the next one's cap is the answer, found with running sums.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: the windows below see names, not documents.
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    capped = F.coalesce(F.sum("limit").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - capped) / free
    found = ranked.withColumn("level", level).withColumn("turn", F.row_number().over(order))
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    water = F.min(F.when(fits, F.struct("turn", "level"))).over(every)["level"]
    return found.withColumn("water", water).select(
        "source", "source_size", "weight",
        F.least(F.col("limit").cast("double"), F.col("water") * F.col("weight")).alias("target"),
    )


def block_of(row_id: Column, blocks: int = BLOCKS) -> Column:
    return hash60(F.lit("block"), F.lit(SEED), row_id) % blocks


def _order(source: Column, item: Column) -> Column:
    return hash60(F.lit("order"), F.lit(SEED), F.coalesce(source, F.lit("")), item)


def _scan(items: Column, start: Column, step, kind: str) -> Column:
    """What ``step`` gives for each of the items in turn, as an array of ``kind``.

    ``step(state, item)`` returns the next state and the item's result. Results are gathered
    in lists of ``_LIST`` and those in a list, so that appending does not cost the square.
    """
    none = F.array().cast(f"array<{kind}>")
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _LIST).cast("int")), lambda i: F.slice(items, i * _LIST + 1, F.lit(_LIST)))

    def one(a: Column, x: Column) -> Column:
        state, got = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["got"], F.array(got.cast(kind))).alias("got"))

    def some(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["state"].alias("state"), none.alias("got")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["all"], F.array(d["got"])).alias("all")))

    start = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.flatten(F.aggregate(lists, start, some, lambda a: a["all"]))


def quotas(with_blocks: DataFrame) -> DataFrame:
    """``(source, block, passes, place)``: draws of each block and its place in the source's order.

    ``with_blocks`` has ``source, block, words, source_size, target``. A block gets the
    source's whole passes. What is left of the target is filled in the permuted order,
    each block taken once more that still fits, so that the words missing in the end are
    fewer than any block left out has.
    """
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    left = F.col("target") - passes * F.col("source_size")
    item = F.struct(_order(F.col("source"), F.col("block")).alias("rank"), "block", "words")
    # At most BLOCKS items a source.
    listed = with_blocks.groupBy("source").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.first(passes).cast("int").alias("full"), F.first(left).alias("left")
    )

    def step(rest: Column, x: Column) -> tuple[Column, Column]:
        fits = (x["words"] <= rest) & (rest > 0)
        return F.when(fits, rest - x["words"]).otherwise(rest), fits

    more = _scan(F.col("items"), F.col("left"), step, "int")
    return listed.select("source", "full", F.posexplode(F.arrays_zip("items", more.alias("more"))).alias("place", "x")).select(
        "source", "x.items.block", (F.col("full") + F.col("x.more")).alias("passes"), "place"
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """Number of good ones among ``drawn`` of ``total``, by inversion at ``u`` in [0, 1).

    Terms are relative to the mode's, so nothing under- or overflows; those beyond
    ``_REACH`` standard deviations count as zero.
    """
    g, n, k = good.cast("double"), total.cast("double"), drawn.cast("double")
    share = g / F.greatest(n, F.lit(1.0))
    facts = F.struct(
        g.alias("g"), n.alias("n"), k.alias("k"), u.alias("u"),
        F.greatest(F.lit(0.0), k - (n - g)).alias("low"), F.least(k, g).alias("high"),
        F.floor((k + 1) * (g + 1) / (n + 2)).cast("double").alias("peak"),
        (F.ceil(F.sqrt(k * share * (1 - share)) * _REACH) + 8).alias("spread"),
    )

    def ratio(p: Column, x: Column) -> Column:
        """The term of x + 1 over that of x."""
        return (p["g"] - x) * (p["k"] - x) / ((x + 1) * (p["n"] - p["g"] - p["k"] + x + 1))

    def terms(p: Column, mode: Column, sign: int, aim: Column | None) -> Column:
        """Outward from the mode: the terms' sum, or the steps taken until it passes ``aim``."""
        far = F.least((p["high"] - mode) if sign > 0 else (mode - p["low"]), p["spread"]).cast("int")
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("z"), F.lit(0).alias("at"))

        def step(a: Column, i: Column) -> Column:
            w = a["w"] * (ratio(p, mode + i - 1) if sign > 0 else 1 / ratio(p, mode - i))
            moved = _let(w, lambda w: F.struct(w.alias("w"), (a["z"] + w).alias("z"), i.alias("at")))
            return moved if aim is None else F.when(a["z"] > aim, a).otherwise(moved)

        walk = F.aggregate(F.sequence(F.lit(1), far), start, step, lambda a: a["z"] if aim is None else a["at"])
        return F.when(far >= 1, walk).otherwise(F.lit(0.0) if aim is None else F.lit(0))

    def at_mode(p: Column) -> Column:
        return _let(F.least(p["high"], F.greatest(p["low"], p["peak"])), lambda mode: around(p, mode))

    def around(p: Column, mode: Column) -> Column:
        sums = F.struct(terms(p, mode, 1, None).alias("up"), terms(p, mode, -1, None).alias("down"))
        return _let(sums, lambda z: _let(p["u"] * (1 + z["up"] + z["down"]), lambda aim: found(p, mode, z, aim)))

    def found(p: Column, mode: Column, z: Column, aim: Column) -> Column:
        above, below = mode + terms(p, mode, 1, aim - 1), mode - terms(p, mode, -1, aim - 1 - z["up"])
        return F.when(aim < 1, mode).when(aim < 1 + z["up"], above).otherwise(below)

    return _let(facts, lambda p: F.when(p["low"] >= p["high"], p["low"]).otherwise(at_mode(p))).cast("long")


def split_quotas(quota: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(shard, source, quota, start)`` from ``(source, quota)``: who gets how many block draws.

    ``start`` is where the shard's range begins among the source's permuted draws. The
    tree's nodes are rows that hold one quota a source; a level turns each node into two.
    With more than ``GROUP`` sources a tree is grown for groups of them first, as if they
    were sources; what a group got in each shard then bounds the tree of its own sources, so
    that no row holds more than a group, and groups are split by many tasks.
    """
    pair = F.struct(F.col("source").isNull().alias("last"), "source", "quota", F.lit(0).cast("long").alias("start"))
    sources = quota.count()
    group = F.pmod(F.xxhash64("source"), F.lit(max(1, 2 * sources // GROUP))) if sources > GROUP else F.lit(0)
    held = quota.groupBy(group.alias("group")).agg(F.sort_array(F.collect_list(pair)).alias("q"))
    if sources > GROUP:
        of_group = written(quota.groupBy(group.alias("group")).agg(F.sum("quota").alias("quota")))
        above = split_quotas(of_group.select(F.col("group").cast("string").alias("source"), "quota"), shards)
        leaves = above.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota")))["quota"].alias("leaves"))
        held = held.join(leaves, F.col("group").cast("string") == F.col("source")).drop("source")
    else:
        held = held.withColumn("leaves", F.lit(None).cast("array<bigint>"))
    nodes = held.select("leaves", F.lit(0).alias("first"), F.lit(shards).alias("wide"), "q")
    # The expressions of a level, built once.
    left = F.floor(F.col("wide") / 2).cast("int")
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    given = F.aggregate(F.slice("leaves", F.col("first") + 1, left), F.lit(0).cast("long"), lambda a, n: a + n)
    start = F.struct(F.col("total").alias("n"), F.coalesce(given, F.floor(F.col("total") * left / F.col("wide"))).alias("k"))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        u = hash60(F.lit("tree"), F.lit(SEED), F.col("first"), F.col("wide"), F.coalesce(x["source"], F.lit("\0"))) / float(1 << 60)
        got = _hypergeometric(x["quota"], a["n"], a["k"], u)
        return F.struct((a["n"] - x["quota"]).alias("n"), (a["k"] - got).alias("k")), got

    got = _scan(F.col("q"), start, step, "bigint")
    kept = F.zip_with("q", "got", lambda x, g: x.withField("quota", g))
    rest = F.zip_with("q", "got", lambda x, g: x.withField("quota", x["quota"] - g).withField("start", x["start"] + g))
    halves = F.array(
        F.struct("leaves", F.col("first"), left.alias("wide"), kept.alias("q")),
        F.struct("leaves", (F.col("first") + left).alias("first"), (F.col("wide") - left).alias("wide"), rest.alias("q")),
    )
    one = F.array(F.struct("leaves", "first", "wide", "q"))
    children = F.explode(F.when(F.col("wide") > 1, halves).otherwise(one)).alias("h")
    widest = shards
    while widest > 1:
        widest = (widest + 1) // 2
        nodes = nodes.select("*", total.alias("total")).select("*", got.alias("got")).select(children).select("h.*")
        if widest == max(1, shards // 8):
            nodes = nodes.repartition(TASKS, F.xxhash64("first", "q"))  # from here on nodes are split by many tasks
    return nodes.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.quota", "x.start")


def draws(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
) -> DataFrame:
    """``(key, block, source_size, target, shards)``, a row for each block of each source that has documents.

    ``key`` is the source as a join key that null can match. ``shards`` lists the output
    shard of each draw of the block, one for each pass; it is empty for blocks left out.
    """
    words = written(sized.groupBy("source", block_of(F.col("row_id"), blocks).alias("block")).agg(F.sum("size").alias("words")))
    by_source = written(targets(words.select("source", F.col("words").alias("size")), weights, cap))
    about = by_source.select(_key(F.col("source")).alias("key"), "source_size", "target")
    known = words.join(about, _key(words["source"]) == F.col("key"))
    quota = written(quotas(known))
    split = split_quotas(quota.groupBy("source").agg(F.sum("passes").cast("long").alias("quota")), shards)
    # Draw number i of a source: whole passes first, each in the permuted order.
    dealt = split.where("quota > 0").select(
        "source", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("i")
    )
    each = quota.where("passes > 0").select("source", "block", "place", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("turn"))
    numbered = each.withColumn("i", F.row_number().over(W.partitionBy("source").orderBy("turn", "place")).cast("long") - 1)
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.i") == F.col("b.i"))
    taken = numbered.alias("a").join(dealt.alias("b"), same).groupBy(_key(F.col("a.source")).alias("key"), "a.block").agg(F.sort_array(F.collect_list("b.shard")).alias("shards"))
    every = known.select("key", "block", "source_size", "target").join(taken, ["key", "block"], "left")
    return written(every.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))))


def _key(source: Column) -> Column:
    """A source as a join key that null can match."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _looked_up(rows: DataFrame, row_id: Column, source: Column, by_block: DataFrame, blocks: int, out: str) -> DataFrame:
    """``rows`` with their blocks' columns as a struct ``out``: on the map side, unless sources are very many."""
    known = by_block.select(F.struct(*by_block.columns).alias(out))
    few = known.count() <= MAX_LOOKED_UP
    return rows.join(F.broadcast(known) if few else known, (_key(source) == F.col(f"{out}.key")) & (block_of(row_id, blocks) == F.col(f"{out}.block")))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
    blocks: int = BLOCKS, shards: int = SHARDS,
) -> DataFrame:
    """``(row_id, source, size, source_size, target, shards)``, one row per row of ``docs``.

    ``shards`` holds the output shard of each time the document is taken; it is empty where
    the document is left out. The same table gives the same plan in every run.

    A null text has size 0; null is a source like any other, ordered last. Documents of a
    source without words are taken in as many passes as fit a target of 0: none. Rows that
    repeat an id share its block and so its draws; a null id is an id. Other columns are not
    read. An empty table gives an empty plan.
    """
    sized = written(sizes(docs, id_col, text_col, source_col))
    rows = _looked_up(sized, F.col("row_id"), F.col("source"), draws(sized, weights, cap, blocks, shards), blocks, "of")
    return rows.select("row_id", "source", "size", "of.source_size", "of.target", "of.shards")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
    blocks: int = BLOCKS, shards: int = SHARDS,
) -> DataFrame:
    """The mix itself: ``docs`` with ``shard`` and ``turn``, a row for each draw of :func:`plan`, shuffled within its shard.

    Texts are moved once, to their shards: what is drawn is looked up by source and block,
    and dealt out in ranges of shard and hash, so that a shard is one run of tasks and is
    read in shuffled order; a shard larger than a task's range is split by the hash. Null
    and repeated ids, null sources and texts as for :func:`plan`; input columns named
    ``shard`` or ``turn`` are replaced, others may have any names.
    """
    by_block = draws(sizes(docs, id_col, text_col, source_col), weights, cap, blocks, shards)
    (of,) = unused(docs, "__of")
    rows = _looked_up(docs, F.col(id_col), F.col(source_col), by_block, blocks, of)
    names = [c for c, name in zip(columns(docs), docs.columns) if name.lower() not in ("shard", "turn")]
    rows = rows.select(*names, F.posexplode(f"{of}.shards").alias("turn", "shard"))
    order = ("shard", hash60(F.lit(SEED), F.col(id_col), F.col("turn")))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_shards(mixed: DataFrame, path: str) -> None:
    """What :func:`mix` gives as Parquet, a folder ``shard=N`` for each shard, whose files in turn are its shuffled order."""
    mixed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
