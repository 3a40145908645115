"""Small panels for requests: one favourite, one opposite, one found by context, as different as can be.

All requests of a table are served at once. Candidates are first cut to the few that can
matter for any request, with windows over the candidates' table; what remains per request
is a list of bounded length, walked through in order with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.operators import topk
from mosaiq.operators.sampling import order_of

#: The tags, and what purchase reasons, categories and prices say about them.
TAGS = ("소극적 실속", "사회적 소비", "윤리적 소비", "적극적 소비", "자기 중심적")
REASON_TAGS = {
    "SNS광고": "적극적 소비",
    "친구추천": "사회적 소비",
    "할인중": "소극적 실속",
    "오래고민중": "윤리적 소비",
    "그냥갖고싶음": "자기 중심적",
    "품절전에": "소극적 실속",
    "기타": "자기 중심적",
}
CATEGORY_TAGS = {
    "굿즈": "사회적 소비",
    "패션·잡화": "적극적 소비",
    "게임": "적극적 소비",
    "문구·다꾸": "자기 중심적",
    "뷰티": "자기 중심적",
    "간식": "소극적 실속",
    "도서": "윤리적 소비",
    "기타": "자기 중심적",
}
LOW_PRICE, HIGH_PRICE = 10_000, 50_000
LOW_TAG, HIGH_TAG, DEFAULT_TAG = "소극적 실속", "적극적 소비", "자기 중심적"
TAG_TYPES = {"소극적 실속": 1, "사회적 소비": 2, "윤리적 소비": 3, "적극적 소비": 4, "자기 중심적": 5}
DEFAULT_TYPE = 1
ARCHETYPE_NAMES = {"Arch_0": "돌봄형", "Arch_1": "창작형", "Arch_2": "사색형", "Arch_3": "평온형", "Arch_4": "향유형"}

POOL, HITS = 5, 200


def price_tag(price: Column) -> Column:
    return F.when(price < LOW_PRICE, LOW_TAG).when(price >= HIGH_PRICE, HIGH_TAG)


def inferred_tags(preferred: Column, reasons: Column, category: Column, price: Column) -> Column:
    """Preferred tags if there are any; else those of the reasons, the category and the price, each once, in that order; else the default."""
    by_reason = F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: T.lookup(r, REASON_TAGS))
    found = F.array_distinct(F.filter(F.concat(by_reason, F.array(T.lookup(category, CATEGORY_TAGS), price_tag(price))), lambda x: x.isNotNull()))
    return F.when(F.size(F.coalesce(preferred, F.array().cast("array<string>"))) > 0, preferred).when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_TAG)))


def context_query(reasons: Column, item: Column, category: Column, extra: Column) -> Column:
    return F.trim(T.joined([F.array_join(reasons, " "), item, category, extra], " "))


def context_block(reasons: Column, item: Column, category: Column, price: Column, extra: Column) -> Column:
    """The request as lines for a prompt; parts that are missing, or a price of 0, leave no trace."""
    shown = F.concat(
        F.coalesce(F.nullif(item, F.lit("")), F.lit("상품")),
        F.when(category != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""),
        F.when(price != 0, F.concat(F.lit(" — "), T.number_mode(price), F.lit("원"))).otherwise(""),
    )
    some = (F.coalesce(item, F.lit("")) != "") | (F.coalesce(category, F.lit("")) != "") | (F.coalesce(price, F.lit(0)) != 0)
    return F.concat_ws(
        "\n", F.lit("[아이의 고민]"), F.when(some, F.concat(F.lit("상품: "), shown)),
        F.when(F.size(reasons) > 0, F.concat(F.lit("구매 이유: "), F.array_join(reasons, " + "))), F.when(extra != "", F.concat(F.lit("하고 싶은 말: "), extra)),
    )


def long_matrix(spark, matrix: dict) -> DataFrame:
    """``(arch, arch_ord, tag, score)`` from a nested mapping, whichever way round, with or without a ``matrix`` wrapper."""
    matrix = matrix.get("matrix", matrix)
    if set(matrix) <= set(TAGS):
        archs = list(dict.fromkeys(a for row in matrix.values() for a in row))
        matrix = {a: {t: row[a] for t, row in matrix.items() if a in row} for a in archs}
    rows = [(a, i, t, float(s)) for i, (a, row) in enumerate(matrix.items()) for t, s in row.items()]
    return spark.createDataFrame(rows, "arch string, arch_ord int, tag string, score double")


def affinity(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(request_id, arch, arch_ord, score)``: for each archetype the sum over the request's ``tags``; 0 for tags it lacks."""
    archs = matrix.groupBy("arch", "arch_ord").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("m"))
    listed = archs.agg(F.collect_list(F.struct("arch", "arch_ord", "m")).alias("archs"))
    each = requests.select("request_id", "tags").crossJoin(F.broadcast(listed)).select("request_id", "tags", F.explode("archs").alias("x"))  # one row
    score = F.aggregate("tags", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(F.col("x.m"), t), F.lit(0.0)))
    return each.select("request_id", "x.arch", "x.arch_ord", score.alias("score"))


def _draw(seed: Column, card: Column) -> Column:
    return F.md5(F.concat_ws("|", seed, card))


_PICK = "struct<card_id:{id},arch:string,tag:string,coherence:double>"


def candidates(cards: DataFrame, depth: int, seed: str = "42") -> DataFrame:
    """The cards that can fill a favourite or opposite slot: of each archetype and tag the most coherent, ``depth`` of them.

    A request excludes at most two cards, so three of each kind are enough whatever it asks
    for; ties in coherence are broken by a fixed hash.
    """
    rank = F.row_number().over(W.partitionBy("arch", "tag").orderBy(F.desc("coherence"), order_of("card_id", seed), "card_id"))
    return cards.withColumn("__r", rank).where(F.col("__r") <= depth).drop("__r")


def select(requests: DataFrame, cards: DataFrame, matrix: DataFrame, hits: DataFrame | None = None, seed: str = "42") -> DataFrame:
    """``(request_id, slot, card_id, arch, tag)``: slots ``favourite``, ``context``, ``opposite`` and ``fill``, three a request if there are as many cards.

    ``requests``: ``request_id, tags, favourites`` (card ids in order of preference).
    ``cards``: ``card_id, ord, arch, tag, coherence``, ``ord`` their order in the source.
    ``hits``: ``request_id, card_id, rank``, a vector search's first ``HITS`` results.

    * favourite: the first known of the favourites; else of the best-matching archetype that
      has cards the most coherent.
    * opposite: of the worst-matching other archetype the most coherent card with another
      tag; without such a card in any archetype, the tag may repeat.
    * context: walking the hits, the first of each new archetype and tag makes a pool; of its
      first five the most coherent. An empty pool takes the first eligible card in source order
      whose tag may repeat only if no card has a new one. Without hits the most coherent.
    * fill: the most coherent left, with new archetype and tag, then new archetype, then any.

    Where the original picks at random among equals, a hash of the seed and the id decides.
    """
    cards = cards.withColumn("coherence", F.coalesce(F.col("coherence").cast("double"), F.lit(0.0)))
    scores = affinity(requests, matrix)
    kind = _PICK.format(id=cards.schema["card_id"].dataType.simpleString())
    few = candidates(cards, 3, seed).select("card_id", "arch", "tag", "coherence", order_of("card_id", seed).alias("h"))

    # Favourite.
    named = requests.select("request_id", F.posexplode("favourites").alias("pos", "card_id")).join(cards.select("card_id", "arch", "tag", "coherence"), "card_id")
    named = named.groupBy("request_id").agg(F.min(F.struct("pos", "card_id", "arch", "tag", "coherence")).alias("n"))
    best = F.min(F.struct((-F.col("score")).alias("a"), F.col("arch_ord"), (-F.col("coherence")).alias("c"), F.col("h"), F.col("card_id"), F.col("arch"), F.col("tag"), F.col("coherence"))).alias("m")
    matched = scores.join(F.broadcast(few), "arch").groupBy("request_id").agg(best)
    pick = lambda s: F.struct(F.col(f"{s}.card_id"), F.col(f"{s}.arch"), F.col(f"{s}.tag"), F.col(f"{s}.coherence")).cast(kind)
    fav = requests.select("request_id").join(named, "request_id", "left").join(matched, "request_id", "left")
    fav = fav.select("request_id", F.when(F.col("n").isNotNull(), pick("n")).otherwise(F.when(F.col("m").isNotNull(), pick("m"))).alias("fav"))

    # Opposite.
    other = scores.join(fav, "request_id").join(F.broadcast(few), "arch")
    other = other.where((F.col("fav").isNull()) | ((F.col("arch") != F.col("fav.arch")) & (F.col("card_id") != F.col("fav.card_id"))))
    worst = F.min(F.struct((F.col("tag") == F.col("fav.tag")).alias("r"), F.col("score"), F.col("arch_ord"), (-F.col("coherence")).alias("c"), F.col("h"), F.col("card_id"), F.col("arch"), F.col("tag"), F.col("coherence"))).alias("o")
    opp = fav.join(other.groupBy("request_id").agg(worst), "request_id", "left").select("request_id", "fav", F.when(F.col("o").isNotNull(), pick("o")).alias("opp"))

    # Context.
    used = opp.withColumn("used", F.array_compact(F.array("fav", "opp"))).withColumn("ids", F.col("used")["card_id"]).withColumn("archs", F.col("used")["arch"]).withColumn("tags", F.col("used")["tag"])
    order = F.row_number().over(W.partitionBy("arch", "tag").orderBy("ord", "card_id"))
    early = cards.withColumn("__r", order).where(F.col("__r") <= 3).select("card_id", "ord", "arch", "tag", "coherence")
    in_order = used.join(F.broadcast(early), ~F.array_contains("ids", F.col("card_id")) & ~F.array_contains("archs", F.col("arch")))
    eligible = in_order.groupBy("request_id").agg(F.min(F.struct(F.array_contains("tags", F.col("tag")).alias("r"), F.col("ord"), F.col("card_id"), F.col("arch"), F.col("tag"), F.col("coherence"))).alias("e"))
    reliable = used.join(F.broadcast(few), ~F.array_contains("ids", F.col("card_id")) & ~F.array_contains("archs", F.col("arch")))
    reliable = reliable.groupBy("request_id").agg(F.min(F.struct(F.array_contains("tags", F.col("tag")).alias("r"), (-F.col("coherence")).alias("c"), F.col("h"), F.col("card_id"), F.col("arch"), F.col("tag"), F.col("coherence"))).alias("s"))
    ctx = used.join(eligible, "request_id", "left").join(reliable, "request_id", "left")
    if hits is not None:
        near = hits.where(F.col("rank") <= HITS).join(cards.select("card_id", "arch", "tag", "coherence"), "card_id")
        near = near.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "card_id", "arch", "tag", "coherence"))).alias("near"))
        ctx = ctx.join(near, "request_id", "left")
        none = F.array().cast(f"array<{kind}>")
        start = F.struct(none.alias("pool"), F.col("archs").alias("archs"), F.col("tags").alias("tags"))

        def step(a: Column, x: Column) -> Column:
            new = ~F.array_contains(F.col("ids"), x["card_id"]) & ~F.array_contains(a["archs"], x["arch"]) & ~F.array_contains(a["tags"], x["tag"]) & (F.size(a["pool"]) < POOL)
            one = F.struct(x["card_id"].alias("card_id"), x["arch"].alias("arch"), x["tag"].alias("tag"), x["coherence"].alias("coherence"))
            grown = F.struct(F.concat(a["pool"], F.array(one)).alias("pool"), F.concat(a["archs"], F.array(x["arch"])).alias("archs"), F.concat(a["tags"], F.array(x["tag"])).alias("tags"))
            return F.when(new, grown).otherwise(a)

        # If the tags that are new are no eligible card's, the walk finds nothing, as a repeated tag is never pooled.
        pool = F.when(F.col("near").isNotNull(), F.aggregate("near", start, step, lambda a: a["pool"]))
        ranked = F.array_min(F.transform(pool, lambda x: F.struct((-x["coherence"]).alias("c"), _draw(F.lit(seed), x["card_id"]).alias("h"), x.alias("x"))))["x"]
        context = F.coalesce(ranked, F.when(F.col("e").isNotNull(), pick("e")))
    else:
        context = F.when(F.col("s").isNotNull(), pick("s"))
    chosen = ctx.select("request_id", "fav", context.alias("ctx"), "opp")

    # Fill.
    chosen = chosen.withColumn("got", F.array_compact(F.array("fav", "ctx", "opp")))
    reserve = candidates_in_order(cards)

    def fill(stage: str):
        def step(a: Column, x: Column) -> Column:
            ids, archs, tags = a["got"]["card_id"], a["got"]["arch"], a["got"]["tag"]
            ok = (F.size(a["got"]) < 3) & ~F.array_contains(ids, x["card_id"])
            if stage != "any":
                ok = ok & ~F.array_contains(archs, x["arch"])
            if stage == "arch_tag":
                ok = ok & ~F.array_contains(tags, x["tag"])
            one = F.struct(x["card_id"].alias("card_id"), x["arch"].alias("arch"), x["tag"].alias("tag"), x["coherence"].alias("coherence"))
            return F.when(ok, F.struct(F.concat(a["got"], F.array(one)).alias("got"))).otherwise(a)

        return step

    filled = chosen.crossJoin(F.broadcast(reserve))  # one row
    for stage in ("arch_tag", "arch", "any"):
        filled = filled.withColumn("got", F.aggregate("reserve", F.struct(F.col("got").alias("got")), fill(stage), lambda a: a["got"]))
    return filled.select("request_id", "fav", "ctx", "opp", F.posexplode("got").alias("position", "x")).select(
        "request_id", "position",
        F.when(F.col("x.card_id") == F.col("fav.card_id"), "favourite").when(F.col("x.card_id") == F.col("ctx.card_id"), "context").when(F.col("x.card_id") == F.col("opp.card_id"), "opposite").otherwise("fill").alias("slot"),
        "x.card_id", "x.arch", "x.tag",
    )


def candidates_in_order(cards: DataFrame) -> DataFrame:
    """One row, ``reserve``: of each archetype and tag the three most coherent cards, in order of coherence, then source order."""
    rank = F.row_number().over(W.partitionBy("arch", "tag").orderBy(F.desc("coherence"), "ord", "card_id"))
    few = cards.withColumn("__r", rank).where(F.col("__r") <= 3)
    item = F.struct((-F.col("coherence")).alias("c"), F.col("ord"), F.col("card_id"), F.col("arch"), F.col("tag"), F.col("coherence"))
    return few.agg(F.sort_array(F.collect_list(item)).alias("reserve"))


def search_hits(requests: DataFrame, cards: DataFrame, k: int = HITS) -> DataFrame:
    """``(request_id, card_id, rank)`` by inner product of ``vector`` columns, favourites not excluded here."""
    q = requests.select("request_id", "vector")
    return topk.batch_search(cards.select("card_id", "vector"), q, k, "card_id", "vector", "request_id", skip_self=False).select("request_id", "card_id", "rank")
