"""The queries' results in DuckDB's SQL.

DuckDB indexes lists from 1 and keeps ``FLOAT[]`` products in single precision, so vectors
are cast to ``DOUBLE[]`` first.
"""

from __future__ import annotations

from mosaiq.functions.text import SPACE
from mosaiq.operators import selection
from mosaiq.plans.constants import AFFINITY, ANSWERS, SCENARIOS

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_ALL = "SELECT *, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM e"
_NORM = "sqrt(list_inner_product({0}, {0}))"
_SPACE = SPACE
_LABELS = 10


def _dist(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


def _unit(v: str, eps: str = "greatest({0}, 1e-10)") -> str:
    n = eps.format(_NORM.format(v))
    return f"list_transform({v}, lambda x: x / {n})"


def _added(v: str) -> str:
    return _unit(v, "({0} + 1e-9)")


def _sub(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def _mean(source: str, keys: str = "") -> str:
    """Element-wise means as lists, by keys."""
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}list(x ORDER BY pos) AS c, any_value(n) AS n FROM (SELECT {k}pos, avg(x) AS x, count(*) AS n FROM "
        f"(SELECT {k}unnest(range(1, 65)) AS pos, unnest(v) AS x FROM {source}) GROUP BY {k}pos) {f'GROUP BY {keys}' if keys else ''}"
    )


def _sims(shift: int = 0) -> str:
    u = "list_transform({0}, lambda x: x / greatest(sqrt(list_inner_product({0}, {0})), 1e-10))"
    return f"""{_E}, m AS ({_mean("e")}),
cs AS (SELECT label AS cluster, c FROM ({_mean("e", "label")})),
ans AS (SELECT (label + {shift}) % {_LABELS} AS anchor, arg_min(v, vec_id) AS v FROM e GROUP BY label),
ca AS (SELECT anchor, {_sub("v", "m.c")} AS w FROM ans, m), cc AS (SELECT cluster, {_sub("cs.c", "m.c")} AS w FROM cs, m),
na AS (SELECT anchor, {u.format("w")} AS w FROM ca), nc AS (SELECT cluster, {u.format("w")} AS w FROM cc),
sims AS (SELECT anchor, cluster, list_inner_product(na.w, nc.w) AS sim FROM na, nc)"""


def _level(i: int) -> str:
    """Of the assignments of the first anchors to each set of clusters, a bit a cluster, the best."""
    return f"l{i + 1} AS (SELECT mask | (1 << cluster) AS mask, max(total + sim) AS total, arg_max(list_append(p, cluster), total + sim) AS p FROM l{i} JOIN sims ON anchor = {i} AND (mask & (1 << cluster)) = 0 GROUP BY 1)"


_BEST = f"""l0 AS (SELECT 0 AS mask, CAST(0 AS DOUBLE) AS total, CAST([] AS INTEGER[]) AS p), {", ".join(map(_level, range(_LABELS)))},
best AS (SELECT unnest(range({_LABELS})) AS anchor, unnest(p) AS cluster FROM l{_LABELS}), chosen AS (SELECT s.anchor, s.cluster, s.sim FROM best JOIN sims s USING (anchor, cluster))"""
_MARGIN = "mg AS (SELECT anchor, s[1] - s[2] AS margin FROM (SELECT anchor, list_reverse_sort(list(sim)) AS s FROM sims GROUP BY anchor))"

_TYPICAL = f"""tm AS ({_mean("e", "label")}), td AS (SELECT e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_dist("v", "c")}, vec_id) AS r FROM e JOIN tm ON e.label = tm.label),
typ AS (SELECT e.*, r FROM e JOIN td USING (vec_id) WHERE r <= 10)"""
_VAL = ["functional", "emotional", "social", "epistemic", "ethical"]
_VALUES = "vals AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 4 + 4 AS {c}" for i, c in enumerate(_VAL)) + " FROM embeddings)"
_CENTRES = (
    "cen AS (SELECT * FROM (VALUES "
    + ", ".join(f"('type{i}', " + ", ".join(f"CAST({5.0 if i == j else 2.0 + 0.25 * j} AS DOUBLE)" for j in range(5)) + ")" for i in range(5))
    + ") t(type, "
    + ", ".join(_VAL)
    + "))"
)


def _moved(c: str) -> str:
    low = f"least(7.0, greatest(1.0, (SELECT avg({c}) - 1.5 * stddev_pop({c}) FROM vals)))"
    high = f"least(7.0, greatest(1.0, (SELECT avg({c}) + 1.5 * stddev_pop({c}) FROM vals)))"
    a, b = f"(SELECT min({c}) FROM cen)", f"(SELECT max({c}) FROM cen)"
    return f"{low} + ({c} - {a}) / CASE WHEN {b} = {a} THEN 1e-9 ELSE {b} - {a} END * ({high} - {low}) AS {c}"


_RESCALED = f"{_VALUES}, {_CENTRES}, resc AS (SELECT type, {', '.join(map(_moved, _VAL))} FROM cen)"
_TYPED = f"""{_RESCALED},
ru AS (SELECT type, [{", ".join(_VAL)}] AS c FROM resc), vu AS (SELECT vec_id, [{", ".join(_VAL)}] AS v FROM vals),
rn AS (SELECT type, {_added("c")} AS c FROM ru), vn AS (SELECT vec_id, {_added("v")} AS v FROM vu),
rk AS (SELECT vec_id, type, list_inner_product(v, c) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(v, c) DESC, type DESC) AS r FROM rn, vn),
two AS (SELECT a.vec_id, a.type AS t1, b.type AS t2, a.sim AS s1, b.sim AS s2 FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)"""

_BUNDLE = """round(coalesce(avg({0}), 0), 6) AS mean, round(coalesce(quantile_cont({0}, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont({0}, 0.95), 0), 6) AS p95,
round(coalesce(min({0}), 0), 6) AS min, round(coalesce(max({0}), 0), 6) AS max, count({0}) AS n"""

_TOKENS = f"list_filter(regexp_split_to_array({{0}}, '{_SPACE}'), lambda x: x <> '')"
_ANSWERS = "ans AS (SELECT conv_id, text, turn AS ordinal FROM conversations WHERE role = 'assistant')"


def _report(group: str, pairs: str, groups: str, extra: str = "") -> str:
    return f"""SELECT g.{group}, coalesce(n, 0) AS n_pairs, round(coalesce(m, 0), 6) AS mean_score, coalesce(m >= 0.25, false) AS passed, w.i AS worst_i, w.j AS worst_j{extra}
FROM (SELECT DISTINCT {group} FROM {groups}) g
LEFT JOIN (SELECT {group}, count(*) AS n, avg(dist) AS m, min({{'dist': dist, 'i': i, 'j': j}}) AS w FROM {pairs} GROUP BY {group}) s ON s.{group} = g.{group}"""


def _lexical(rows: str, group: str, ordinal: str, text: str) -> str:
    """CTEs that end in ``pairs``: distances of the texts of a group."""
    return f"""w AS (SELECT {group}, {ordinal} AS o, word, count(*) AS n FROM (SELECT {group}, {ordinal}, unnest({_TOKENS.format(text)}) AS word FROM {rows}) GROUP BY ALL),
len AS (SELECT {group}, {ordinal} AS o, len({_TOKENS.format(text)}) AS l FROM {rows}),
ov AS (SELECT a.{group}, a.o AS i, b.o AS j, sum(least(a.n, b.n)) AS c FROM w a JOIN w b ON a.{group} = b.{group} AND a.word = b.word AND a.o < b.o GROUP BY ALL),
pairs AS (SELECT a.{group}, a.o AS i, b.o AS j, 1 - CASE WHEN a.l = 0 THEN 0 ELSE coalesce(ov.c, 0) / a.l END AS dist
  FROM len a JOIN len b ON a.{group} = b.{group} AND a.o < b.o LEFT JOIN ov ON ov.{group} = a.{group} AND ov.i = a.o AND ov.j = b.o)"""


_GRP = f"{_E}, g AS (SELECT vec_id // 3 AS grp, vec_id % 3 AS o, v FROM e)"


def _vec_pairs(part: str) -> str:
    a, b = part.format("a.v"), part.format("b.v")
    return f"SELECT a.grp, a.o AS i, b.o AS j, 1 - list_cosine_similarity({a}, {b}) AS dist FROM g a JOIN g b ON a.grp = b.grp AND a.o < b.o"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in values.items()) + "}"


#: Categories and reasons that parts stand for, one of each unknown to the tag tables.
CATEGORIES, REASONS = [*selection.CATEGORY_TAGS, "none of these"], [*selection.REASON_TAGS, "none of these"]
_SCEN = f"""sc AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, [{", ".join(map(_literal, CATEGORIES))}][p_partkey % {len(CATEGORIES)} + 1] AS category,
  [{", ".join(map(_literal, REASONS))}][p_partkey % {len(REASONS) - 1} + 1 : p_partkey % {len(REASONS) - 1} + p_partkey % 3] AS reasons, p_name AS item, CAST(floor(CAST(p_retailprice AS DOUBLE) * p_size) AS INTEGER) AS price FROM part)"""
_TAGGED = f"""{_SCEN}, raw AS (SELECT *, list_filter(list_concat(list_transform(reasons, lambda r: {_map(selection.REASON_TAGS)}[r]),
  [{_map(selection.CATEGORY_TAGS)}[category], CASE WHEN price < 10000 THEN '{selection.LOW_TAG}' WHEN price >= 50000 THEN '{selection.HIGH_TAG}' END]), lambda x: x IS NOT NULL) AS l FROM sc),
tg AS (SELECT *, CASE WHEN len(l) = 0 THEN ['{selection.DEFAULT_TAG}'] ELSE list_filter(l, lambda x, i: list_position(l, x) = i) END AS tags FROM raw)"""
_MATRIX = (
    "mx AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {i}, {_literal(t)}, CAST({s} AS DOUBLE))" for i, (a, row) in enumerate(AFFINITY.items()) for t, s in row.items()) + ") t(arch, arch_ord, tag, score))"
)
_TAGLIST = "[" + ", ".join(map(_literal, selection.TAGS)) + "]"


def _sample(stratum: str, source: str, id_col: str, n: int, excluded: str, carry: bool) -> str:
    quota = (
        "qt AS (SELECT stratum, size, i, least(CAST(@n AS BIGINT) // k, size) AS q, @n - least(CAST(@n AS BIGINT) // k, size) AS rest FROM sz WHERE i = 1 "
        "UNION ALL SELECT sz.stratum, sz.size, sz.i, least(rest // (k - sz.i + 1), sz.size), rest - least(rest // (k - sz.i + 1), sz.size) FROM qt JOIN sz ON sz.i = qt.i + 1)"
        if carry
        else "qt AS (SELECT stratum, least(@n // k, size) AS q FROM sz)"
    ).replace("@n", str(n))
    return f"""WITH RECURSIVE r AS (SELECT *, {stratum} AS stratum FROM {source}), rr AS (SELECT * FROM r WHERE stratum <> '{excluded}'),
sz AS (SELECT stratum, count(*) AS size, row_number() OVER (ORDER BY count(*), stratum) AS i, count(*) OVER () AS k FROM rr GROUP BY stratum), {quota},
o AS (SELECT {id_col}, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || {id_col}), {id_col}) AS rn FROM rr)
SELECT {id_col}, o.stratum FROM o JOIN qt ON qt.stratum = o.stratum WHERE rn <= q"""


def _panel(with_hits: bool) -> str:
    """Selection in SQL: windows and anti-joins slot by slot."""
    context = (
        """hit AS (SELECT request_id, card_id, arch, tag, coherence, r FROM (SELECT q.request_id, c.*, row_number() OVER (PARTITION BY q.request_id ORDER BY list_inner_product(q.v, c.v) DESC, c.card_id) AS r FROM q, c) WHERE r <= 200),
ok AS (SELECT h.*, row_number() OVER (PARTITION BY h.request_id ORDER BY r) AS s FROM hit h JOIN two t ON t.request_id = h.request_id
  WHERE h.arch NOT IN (t.fa, t.oa) AND h.tag NOT IN (t.ft, t.ot) AND h.card_id NOT IN (t.fc, t.oc)),
walk AS (
  SELECT request_id, s, [card_id] AS pool, [arch] AS archs, [tag] AS tags FROM ok WHERE s = 1
  UNION ALL
  SELECT w.request_id, o.s, CASE WHEN n THEN w.pool || [o.card_id] ELSE w.pool END, CASE WHEN n THEN w.archs || [o.arch] ELSE w.archs END, CASE WHEN n THEN w.tags || [o.tag] ELSE w.tags END
  FROM walk w JOIN (SELECT * FROM ok) o ON o.request_id = w.request_id AND o.s = w.s + 1,
    LATERAL (SELECT NOT list_contains(w.archs, o.arch) AND NOT list_contains(w.tags, o.tag) AND len(w.pool) < 5 AS n)
),
pool AS (SELECT request_id, unnest(pool) AS card_id FROM (SELECT request_id, arg_max(pool, s) AS pool FROM walk GROUP BY request_id)),
pooled AS (SELECT request_id, arg_min(card_id, {'c': -coherence, 'h': md5('42|' || card_id)}) AS card_id FROM pool JOIN c USING (card_id) GROUP BY request_id),
elig AS (SELECT t.request_id, arg_min(c.card_id, {'r': c.tag IN (t.ft, t.ot), 'o': c.ord}) AS card_id FROM two t JOIN c ON c.arch NOT IN (t.fa, t.oa) AND c.card_id NOT IN (t.fc, t.oc) GROUP BY t.request_id),
ctx AS (SELECT t.request_id, coalesce(p.card_id, e.card_id) AS card_id FROM two t LEFT JOIN pooled p USING (request_id) LEFT JOIN elig e USING (request_id))"""
        if with_hits
        else """ctx AS (SELECT t.request_id, arg_min(c.card_id, {'r': c.tag IN (t.ft, t.ot), 'c': -c.coherence, 'h': md5('42|' || c.card_id)}) AS card_id FROM two t JOIN c ON c.arch NOT IN (t.fa, t.oa) AND c.card_id NOT IN (t.fc, t.oc) GROUP BY t.request_id)"""
    )
    return f"""WITH RECURSIVE {_MATRIX},
c AS (SELECT vec_id AS card_id, vec_id AS ord, 'Arch_' || (vec_id % 5) AS arch, {_TAGLIST}[(vec_id // 5) % 5 + 1] AS tag, CAST(vec_id % 3 AS DOUBLE) AS coherence, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS request_id, [{_TAGLIST}[vec_id % 5 + 1], {_TAGLIST}[(vec_id // 7) % 5 + 1]] AS tags, vec_id % 4 = 0 AS nofav, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0),
qt AS (SELECT request_id, unnest(tags) AS tag FROM q),
sc AS (SELECT request_id, arch, any_value(arch_ord) AS arch_ord, sum(score) AS score FROM qt JOIN mx USING (tag) GROUP BY request_id, arch),
fav AS (SELECT q.request_id, coalesce(max(k.card_id), arg_min(c.card_id, {{'a': -sc.score, 'b': sc.arch_ord, 'c': -c.coherence, 'h': md5('42|' || c.card_id)}})) AS card_id
  FROM q JOIN sc USING (request_id) JOIN c USING (arch) LEFT JOIN c k ON NOT q.nofav AND k.card_id = q.request_id + 1 GROUP BY q.request_id),
ff AS (SELECT fav.request_id, c.card_id AS fc, c.arch AS fa, c.tag AS ft FROM fav JOIN c USING (card_id)),
opp AS (SELECT ff.request_id, arg_min(c.card_id, {{'r': c.tag = ft, 'a': sc.score, 'b': sc.arch_ord, 'c': -c.coherence, 'h': md5('42|' || c.card_id)}}) AS card_id
  FROM ff JOIN sc USING (request_id) JOIN c USING (arch) WHERE c.arch <> fa AND c.card_id <> fc GROUP BY ff.request_id),
two AS (SELECT ff.*, c.card_id AS oc, c.arch AS oa, c.tag AS ot FROM ff JOIN opp USING (request_id) JOIN c USING (card_id)),
{context},
slots AS (SELECT request_id, 0 AS position, 'favourite' AS slot, fc AS card_id FROM two UNION ALL SELECT request_id, 1, 'context', card_id FROM ctx UNION ALL SELECT request_id, 2, 'opposite', oc FROM two)
SELECT request_id, position, slot, card_id, arch, tag FROM slots JOIN c USING (card_id)"""


_GATE_TURN = """
n{t} AS (SELECT s.request, s.slot, s.at, s.done, coalesce(p.text, '[failed]') AS text, coalesce(p.ok, false) AS ok FROM s{t} s LEFT JOIN p ON p.request = s.request AND p.slot = s.slot AND p.attempt = s.at),"""


def _gate() -> str:
    """The three attempts one after the other."""
    parts = [
        f"""WITH t AS (SELECT conv_id AS request, turn % 2 AS slot, turn // 2 AS attempt, text FROM conversations),
h AS (SELECT *, substr(text, 1, 300) AS head FROM t),
p AS (SELECT request, slot, attempt, CASE WHEN length(text) <= 300 THEN text WHEN length(regexp_extract(head, '(?s)^.*[。!?.]')) > 21 THEN regexp_extract(head, '(?s)^.*[。!?.]') ELSE head END AS text, length(text) >= 20 AS ok FROM h),
s0 AS (SELECT DISTINCT request, slot, 0 AS at, false AS done FROM t),"""
    ]
    for t in range(3):
        parts.append(_GATE_TURN.format(t=t))
        rows = f"n{t}" if t < 2 else "valid"
        if t == 2:
            parts.append("valid AS (SELECT * FROM n2 WHERE ok),")
        parts.append(
            f"""w{t} AS (SELECT request, slot AS o, word, count(*) AS n FROM (SELECT request, slot, unnest({_TOKENS.format("text")}) AS word FROM {rows}) GROUP BY ALL),
l{t} AS (SELECT request, slot AS o, len({_TOKENS.format("text")}) AS l FROM {rows}),
v{t} AS (SELECT a.request, a.o AS i, b.o AS j, sum(least(a.n, b.n)) AS c FROM w{t} a JOIN w{t} b ON a.request = b.request AND a.word = b.word AND a.o < b.o GROUP BY ALL),
d{t} AS (SELECT a.request, a.o AS i, b.o AS j, 1 - CASE WHEN a.l = 0 THEN 0 ELSE coalesce(c, 0) / a.l END AS dist FROM l{t} a JOIN l{t} b ON a.request = b.request AND a.o < b.o LEFT JOIN v{t} x ON x.request = a.request AND x.i = a.o AND x.j = b.o),
r{t} AS (SELECT request, avg(dist) AS m, min({{'d': dist, 'i': i, 'j': j}}).j AS wj FROM d{t} GROUP BY request),"""
        )
        if t < 2:
            parts.append(
                f"""f{t} AS (SELECT request, bool_and(ok) AS full_ FROM n{t} GROUP BY request),
s{t + 1} AS (SELECT n.request, n.slot, n.at + CASE WHEN done THEN 0 WHEN NOT ok THEN 1 WHEN full_ AND NOT coalesce(m >= 0.25, false) AND slot = wj THEN 1 ELSE 0 END AS at, done OR (full_ AND coalesce(m >= 0.25, false)) AS done
  FROM n{t} n JOIN f{t} USING (request) LEFT JOIN r{t} USING (request)),"""
            )
    parts.append("z AS (SELECT 1) SELECT n.request, n.slot, n.at AS attempt, n.ok AS is_valid, round(coalesce(m, 0), 6) AS mean_score, coalesce(m >= 0.25, false) AS passed FROM n2 n LEFT JOIN r2 USING (request)")
    return "\n".join(parts)


_POST = "CASE WHEN length(text) <= 300 THEN text WHEN length(regexp_extract(substr(text, 1, 300), '(?s)^.*[。!?.]')) > 21 THEN regexp_extract(substr(text, 1, 300), '(?s)^.*[。!?.]') ELSE substr(text, 1, 300) END"

SQL: dict[str, str] = {
    "vector_norms": f"""WITH {_E}, u AS (SELECT *, {_unit("v")} AS a, {_added("v")} AS b FROM e)
SELECT vec_id, round({_NORM.format("v")}, 6) AS norm, round({_NORM.format("a")}, 6) AS unit_norm, round({_NORM.format("b")}, 6) AS unit_norm_added FROM u""",
    "exact_topk": f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "topk_excluding": f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND e.vec_id - q.vec_id NOT IN (0, 4, 6))
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "ivf_recall": "SELECT count(*) * 10 AS n, true AS recall_ok, false AS scores_differ FROM embeddings WHERE vec_id % 20 = 0",
    "cluster_centroids": f"""WITH {_E} SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, pos - 1 AS pos, round(avg(x), 6) AS x FROM ({_ALL}) GROUP BY label, pos
UNION ALL SELECT 'ALL', count(*), pos - 1, round(avg(x), 6) FROM ({_ALL}) GROUP BY pos""",
    "anchor_similarity_matrix": f"WITH {_sims()} SELECT anchor, cluster, round(sim, 6) AS sim FROM sims",
    "optimal_assignment": f"WITH {_sims(2)}, {_BEST} SELECT anchor, cluster, round(sim, 6) AS sim FROM chosen",
    "assignment_margins": f"WITH {_sims()}, {_MARGIN} SELECT anchor, round(margin, 6) AS margin, margin < 0.05 AS low_conf FROM mg",
    "assignment_quality": f"WITH {_sims()}, {_BEST}, {_MARGIN} SELECT round(min(sim), 6) AS min_cos, round(avg(sim), 6) AS mean_cos, (SELECT round(min(margin), 6) FROM mg) AS min_margin FROM chosen",
    "cluster_medoids": f"""WITH {_E}, m AS ({_mean("e", "label")}), d AS (SELECT e.label, vec_id, {_dist("v", "c")} AS distance FROM e JOIN m ON e.label = m.label)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) <= 3""",
    "medoid_and_others": f"""WITH {_E}, m AS ({_mean("e", "label")}), d AS (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_dist("v", "c")}, vec_id) AS r FROM e JOIN m ON e.label = m.label),
o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS rank FROM d WHERE r > 1)
SELECT label, vec_id, 0 AS rank FROM d WHERE r = 1 UNION ALL SELECT label, vec_id, rank FROM o WHERE rank <= 4""",
    "entropy_noise": f"""WITH {_E}, m AS ({_mean("e", "label")}),
i AS (SELECT e.vec_id, m.label, 1.0 / greatest({_dist("e.v", "m.c")}, 1e-8) AS w FROM e, m), p AS (SELECT vec_id, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM i),
h AS (SELECT vec_id, -sum(p * ln(greatest(p, 1e-12))) AS entropy FROM p GROUP BY vec_id)
SELECT vec_id, round(entropy, 6) AS entropy, CAST(entropy >= (SELECT quantile_cont(entropy, 0.9) FROM h) AS INTEGER) AS noise_dist FROM h""",
    "crosstab_all": """SELECT g.lang, g.quality, coalesce(n, 0) AS n FROM (SELECT lang, quality FROM (SELECT DISTINCT lang FROM documents), (VALUES (0), (1), (2)) t(quality)) g
LEFT JOIN (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) c ON c.lang = g.lang AND c.quality = g.quality""",
    "crosstab_clean": """WITH l AS (SELECT * FROM labels WHERE toxic = 0)
SELECT g.lang, g.quality, coalesce(n, 0) AS n FROM (SELECT lang, quality FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT quality FROM l)) g
LEFT JOIN (SELECT lang, quality, count(*) AS n FROM documents JOIN l USING (doc_id) GROUP BY ALL) c ON c.lang = g.lang AND c.quality = g.quality""",
    "value_shares": "SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20",
    "cluster_imbalance": """WITH s AS (SELECT count(*) AS n FROM embeddings GROUP BY label)
SELECT round(max(n) / sum(n), 6) AS max_share, round(min(n) / sum(n), 6) AS min_share, round(min(n) / max(n), 6) AS balance, max(n) / sum(n) > 0.5 AS too_large, min(n) / sum(n) < 0.05 AS too_small FROM s""",
    "centroid_rescale": f"WITH {_RESCALED} SELECT type, {', '.join(f'round({c}, 6) AS {c}' for c in _VAL)} FROM resc",
    "top2_types": f"WITH {_TYPED} SELECT vec_id, t1 AS type1, CASE WHEN s2 >= 0.97 THEN t2 END AS type2, round(s1, 6) AS top1_sim, round(s2, 6) AS top2_sim FROM two WHERE s1 >= 0.97",
    "threshold_loss_curve": f"WITH {_TYPED} SELECT CAST(round(0.8 + 0.01 * i, 2) AS DOUBLE) AS threshold, round(avg(CASE WHEN s1 < CAST(round(0.8 + 0.01 * i, 2) AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS share FROM two, range(19) t(i) GROUP BY i",
    "anchor_max_scaled": f"""WITH {_E}, {_TYPICAL}, r AS (SELECT e.vec_id, a.label AS anchor_group, max(list_inner_product(e.v, a.v) / greatest({_NORM.format("e.v")} * {_NORM.format("a.v")}, 1e-10)) AS raw FROM e, typ a WHERE a.r <= 3 GROUP BY ALL),
p AS (SELECT quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM r)
SELECT vec_id, anchor_group, round(raw, 6) AS raw, round((greatest(lo, least(hi, raw)) - lo) / (hi - lo) * 6, 6) AS score FROM r, p""",
    "weighted_knn_score": f"""WITH {_E}, {_TYPICAL}, s AS (SELECT e.vec_id, h.vec_id % 6 AS f, h.vec_id % 4 AS so, list_cosine_similarity(e.v, h.v) AS sim FROM e, typ h WHERE e.vec_id <> h.vec_id),
k AS (SELECT vec_id, sum(sim * f) / sum(sim) AS f, sum(sim * so) / sum(sim) AS so FROM s WHERE sim >= 0.25 GROUP BY vec_id)
SELECT e.vec_id, round(coalesce(f, 0), 6) AS functional, round(coalesce(so, 0), 6) AS social FROM e LEFT JOIN k USING (vec_id)""",
    "score_fusion": f"""WITH {_E}, {_TYPICAL}, {_VALUES}, s AS (SELECT e.vec_id, h.vec_id % 6 AS f, h.vec_id % 4 AS so, list_cosine_similarity(e.v, h.v) AS sim FROM e, typ h WHERE e.vec_id <> h.vec_id),
k AS (SELECT vec_id, sum(sim * f) / sum(sim) AS f, sum(sim * so) / sum(sim) AS so FROM s WHERE sim >= 0.25 GROUP BY vec_id),
j AS (SELECT vals.*, coalesce(f, 0) AS f, coalesce(so, 0) AS so, CASE WHEN coalesce(f, 0) + coalesce(so, 0) > 0 THEN 0.5 ELSE 0 END AS a FROM vals LEFT JOIN k USING (vec_id))
SELECT vec_id, round((a * f + 1.5 * functional) / (a + 1.5 + 1e-9), 6) AS functional, round((a * so + 1.5 * social) / (a + 1.5 + 1e-9), 6) AS social FROM j""",
    "structural_noise": f"""WITH {_E}, m AS ({_mean("e")}),
b AS (SELECT vec_id, list_transform(range(4), lambda i: v[i * 16 + 1:i * 16 + 16]) AS p, list_transform(range(4), lambda i: m.c[i * 16 + 1:i * 16 + 16]) AS q FROM e, m),
c AS (SELECT *, list_transform(range(1, 17), lambda k: (p[1][k] + p[2][k] + p[3][k] + p[4][k]) / 4) AS ctr FROM b),
s AS (SELECT vec_id, ({" + ".join(_dist(f"p[{i}]", f"q[{i}]") for i in range(1, 5))}) / 4 AS d, {_NORM.format("ctr")} AS n,
  ({" + ".join(f"pow({_dist(f'p[{i}]', 'ctr')}, 2)" for i in range(1, 5))}) / 64 AS k FROM c),
f AS (SELECT *, CAST(d <= (SELECT quantile_cont(d, 0.2) FROM s) AS INTEGER) + CAST(n >= (SELECT quantile_cont(n, 0.8) FROM s) AS INTEGER) + CAST(k <= (SELECT quantile_cont(k, 0.2) FROM s) AS INTEGER) AS flags FROM s)
SELECT vec_id, round(d, 6) AS "distinct", round(n, 6) AS emb_norm, round(k, 6) AS consistency, flags, flags >= 2 AS noise_struct FROM f""",
    "quota_sample": _sample("CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 1000 THEN 'b' WHEN c_acctbal < 6000 THEN 'c' ELSE 'other' END", "customer", "c_custkey", 500, "other", True),
    "stratified_sample": _sample("c_mktsegment", "customer", "c_custkey", 500, "MACHINERY", False),
    "exact_hash_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
    "keep_first": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "stat_bundle": f"SELECT coalesce(event_type, 'ALL') AS event_type, {_BUNDLE.format('value')} FROM events GROUP BY ROLLUP (event_type)",
    "trial_rates": "SELECT user_id, round(avg(CASE WHEN value >= 25 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(DISTINCT event_type) = 3 AS three_types FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "token_stats": f"WITH t AS (SELECT lang, CAST(len({_TOKENS.format('text')}) AS DOUBLE) AS k FROM documents) SELECT coalesce(lang, 'ALL') AS lang, {_BUNDLE.format('k')}, round(quantile_cont(k, 0.99), 6) AS p99, round(avg(CASE WHEN k > 512 THEN 1.0 ELSE 0.0 END), 6) AS over FROM t GROUP BY ROLLUP (lang)",
    "lexical_diversity": f"WITH {_ANSWERS}, {_lexical('ans', 'conv_id', 'ordinal', 'text')} {_report('conv_id', 'pairs', 'ans')}",
    "ngram_counts": f"""WITH {_ANSWERS}, w AS (SELECT conv_id, {_TOKENS.format("text")} AS w FROM ans)
SELECT conv_id, gram, count(*) AS n FROM (SELECT conv_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) > 1) GROUP BY ALL""",
    "embedding_diversity": f"WITH {_GRP}, pairs AS ({_vec_pairs('{0}')}) {_report('grp', 'pairs', 'g')}",
    "scorer_ablation": f"""WITH {_GRP}, d AS (SELECT 'all' AS model, * FROM ({_vec_pairs("{0}")}) UNION ALL SELECT 'first', * FROM ({_vec_pairs("{0}[1:32]")}) UNION ALL SELECT 'second', * FROM ({_vec_pairs("{0}[33:64]")})),
m AS (SELECT model, grp, avg(dist) AS m FROM d GROUP BY ALL)
SELECT model, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(min(m), 6) AS min, round(max(m), 6) AS max, count(*) AS n FROM m GROUP BY model""",
    "response_postprocess": f"SELECT conv_id, turn, {_POST} AS text, length(text) >= 20 AS is_valid, length({_POST}) AS n_chars FROM conversations",
    "retry_gate": _gate(),
    "prefix_saturation": f"""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents), f AS (SELECT word, min(doc_id) AS at FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS word FROM n) GROUP BY word),
p AS (SELECT DISTINCT least(x, (SELECT count(*) FROM documents)) AS prefix FROM (VALUES (100), (200), (300), (400), (500), (1000000000000)) t(x)),
c AS (SELECT prefix, count(f.at) AS n_unique FROM p LEFT JOIN f ON f.at < prefix GROUP BY prefix),
g AS (SELECT *, coalesce(lag(n_unique) OVER (ORDER BY prefix), 0) AS b FROM c), h AS (SELECT *, (n_unique - b) / greatest(b, 1) * 100 AS growth FROM g)
SELECT prefix, n_unique, round(growth, 6) AS growth, coalesce(prefix = (SELECT min(prefix) FROM h WHERE b > 0 AND growth < 5), false) AS saturated FROM h""",
    "tag_inference": f"""WITH {_TAGGED} SELECT request_id, array_to_string(tags, ',') AS tags, concat_ws(' ', nullif(array_to_string(reasons, ' '), ''), item, category) AS query,
'[아이의 고민]' || chr(10) || '상품: ' || item || ' (' || category || ') — ' || format('{{:,}}', price) || '원' || CASE WHEN len(reasons) > 0 THEN chr(10) || '구매 이유: ' || array_to_string(reasons, ' + ') ELSE '' END AS block FROM tg""",
    "affinity_scores": f"WITH {_TAGGED}, {_MATRIX}, u AS (SELECT request_id, unnest(tags) AS tag FROM tg) SELECT request_id, arch, sum(score) AS score FROM u JOIN mx USING (tag) GROUP BY ALL",
    "mentor_selection": _panel(True),
    "mentor_selection_reliable": _panel(False),
    "greedy_dedupe": f"""WITH RECURSIVE {_E}, n AS (SELECT vec_id, label, {_added("v")} AS v FROM e),
pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) >= 0.3),
near AS (SELECT a, list(b) AS bs FROM pr GROUP BY a),
ord AS (SELECT n.vec_id, coalesce(bs, []) AS bs, row_number() OVER (ORDER BY n.vec_id) AS i FROM n LEFT JOIN near ON near.a = n.vec_id),
walk AS (SELECT i, [vec_id] AS hs FROM ord WHERE i = 1 UNION ALL
  SELECT o.i, CASE WHEN len(list_intersect(o.bs, w.hs)) = 0 THEN w.hs || [o.vec_id] ELSE w.hs END FROM walk w JOIN ord o ON o.i = w.i + 1),
hd AS (SELECT unnest(hs) AS head FROM (SELECT hs FROM walk ORDER BY i DESC LIMIT 1)),
gr AS (SELECT head, head AS vec_id FROM hd UNION ALL SELECT head, b FROM hd JOIN pr ON a = head),
gm AS (SELECT head, list(x ORDER BY pos) AS m FROM (SELECT head, pos, avg(x) AS x FROM (SELECT head, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM gr JOIN n USING (vec_id)) GROUP BY head, pos) GROUP BY head),
rp AS (SELECT head, arg_max(vec_id, {{'s': round(list_inner_product(v, {_added("m")}), 12), 'i': -vec_id}}) AS representative FROM gr JOIN n USING (vec_id) JOIN gm USING (head) GROUP BY head)
SELECT l.vec_id, representative FROM (SELECT vec_id, max(head) AS head FROM gr GROUP BY vec_id) l JOIN rp USING (head)""",
    "fixed_label_quality": f"""WITH {_E}, m AS ({_mean("e", "label")}), a AS ({_mean("e")}),
s AS (SELECT e.label, avg({_dist("v", "c")}) AS s, sum(pow({_dist("v", "c")}, 2)) AS w FROM e JOIN m ON e.label = m.label GROUP BY e.label),
f AS (SELECT m.label, m.c, m.n, s.s, s.w FROM m JOIN s USING (label)),
db AS (SELECT avg(w) AS db FROM (SELECT x.label, max((x.s + y.s) / {_dist("x.c", "y.c")}) AS w FROM f x JOIN f y ON x.label <> y.label GROUP BY x.label))
SELECT count(*) AS k, CAST(sum(f.n) AS BIGINT) AS n, round((SELECT db FROM db), 6) AS davies_bouldin,
  round((sum(f.n * pow({_dist("f.c", "a.c")}, 2)) / (count(*) - 1)) / (sum(w) / (sum(f.n) - count(*))), 6) AS calinski_harabasz FROM f, a""",
    "sampled_silhouette": f"""WITH {_E}, s AS (SELECT * FROM e ORDER BY md5('42|' || vec_id), vec_id LIMIT 5000),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg({_dist("a.v", "b.v")}) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY ALL),
o AS (SELECT vec_id, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM o""",
    "label_agreement": """WITH p AS (SELECT label AS a, (label + vec_id % 3) // 2 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c)
SELECT round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM r, q, i""",
    "rank_correlation": f"""WITH {_VALUES}, r AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _VAL[:3])} FROM vals)
SELECT 'functional' AS a, 'emotional' AS b, round(corr(functional, emotional), 6) AS rho FROM r UNION ALL SELECT 'functional', 'social', round(corr(functional, social), 6) FROM r
UNION ALL SELECT 'emotional', 'social', round(corr(emotional, social), 6) FROM r""",
    "value_histogram": "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE CAST(floor(value / 200 * 20) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY bin",
    "prompt_parts": f"""WITH c AS (SELECT *, {_TOKENS.format("text")} AS w, replace(trim(split_part(text, ',', 1)), 'a', 'b') AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN h = '' THEN 'unknown' ELSE h END AS head, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'und') THEN 'und' WHEN contains(text, 'de') THEN 'de' ELSE 'none' END AS keyword,
  array_to_string(w[1:5], ', ') AS first_words, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS type, 'role: ' || role || ' | turn: ' || turn AS labelled FROM c""",
    "clusters_hold": "SELECT true AS no_trace, true AS ari_in_bounds, true AS unit, count(*) AS n, 10 AS clusters FROM embeddings",
    "explained_variance": "SELECT any_value(len(embedding)) AS components, true AS sums_to_one, true AS descending, true AS enough FROM embeddings",
    "encoded_texts": f"SELECT doc_id, CAST(64 AS BIGINT) AS dim, CASE WHEN len({_TOKENS.format('text')}) > 0 THEN 1.0 ELSE 0.0 END AS text_norm, CASE WHEN source <> 'src0' THEN 1.0 ELSE 0.0 END AS source_norm FROM documents",
    "encoded_lists": f"""WITH c AS (SELECT conv_id || '-' || turn AS id, list_filter({_TOKENS.format("text")}, lambda w: length(w) > 3) AS w FROM conversations)
SELECT id, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END AS norm FROM c""",
    "csv_round_trip": "SELECT * FROM customer",
    "parquet_rolled": "SELECT c_custkey, c_name FROM customer",
    "json_array": f"WITH {_SCEN} SELECT request_id AS id, item, price, CAST(NULL AS VARCHAR) AS missing FROM sc",
    "key_equality": "SELECT true AS reordered, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS fewer, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS more",
    "json_requests": """SELECT '{"custom_id":"req-' || (doc_id + 1000) || '","method":"POST","body":{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS value FROM documents""",
    "json_mapping": "SELECT vec_id, CASE WHEN label <> 3 THEN 'type ' || label END AS label FROM embeddings",
    "resumed_chunks": "SELECT c_custkey // 100 % 7 AS chunk, count(*) AS n, round(sum(c_acctbal), 6) AS total FROM customer GROUP BY 1",
    "parsed_properties": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS missing FROM events",
    "score_attach": "SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN CAST(l.quality AS DOUBLE) ELSE 0 END AS score FROM documents d LEFT JOIN labels l USING (doc_id)",
    "score_equal": "SELECT doc_id FROM labels WHERE quality = 1",
    "align_zero_fill": f"WITH {_E} SELECT d.doc_id AS vec_id, round(coalesce({_NORM.format('v')}, 0), 6) AS norm FROM documents d LEFT JOIN e ON e.vec_id = d.doc_id",
    "align_drop": f"WITH {_E} SELECT vec_id, round({_NORM.format('v')}, 6) AS norm FROM documents d JOIN e ON e.vec_id = d.doc_id",
    "cached_lookup": """WITH w AS (SELECT e.vec_id, CAST(e.label AS BIGINT) AS label FROM embeddings e WHERE vec_id IN (SELECT doc_id FROM labels))
SELECT vec_id, label, true AS cached FROM w UNION ALL SELECT vec_id, CASE WHEN (SELECT min(vec_id) FROM w) > 50 THEN label ELSE -1 END, false FROM w""",
    "label_merge": """SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS lost
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "scenario_lookup": f"""WITH {_SCEN}, w AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT request_id AS id, category, CASE WHEN k % 3 <> 0 THEN item ELSE 'derived ' || item END AS item FROM w JOIN sc ON request_id = CAST(k AS VARCHAR) WHERE k % 3 <> 0 OR k % 2 = 0""",
    "age_bands": """SELECT p_partkey, CASE WHEN a BETWEEN 19 AND 29 THEN '19-29' WHEN a BETWEEN 30 AND 49 THEN '30-49' WHEN a BETWEEN 50 AND 69 THEN '50-69' ELSE 'other' END AS band,
CASE WHEN a BETWEEN 19 AND 29 THEN '19-29' WHEN a BETWEEN 30 AND 49 THEN '30-49' WHEN a BETWEEN 50 AND 69 THEN '50-69' WHEN a >= 70 THEN '70+' ELSE 'other' END AS band_70 FROM (SELECT p_partkey, p_size * 2 AS a FROM part)""",
    "persona_texts": f"""WITH c AS (SELECT *, {_TOKENS.format("text")} AS w FROM conversations), d AS (SELECT *, array_to_string(w, ' ') AS h, regexp_replace(array_to_string(w, ' '), '[''"\\[\\],]', '', 'g') AS plain FROM c)
SELECT conv_id, turn, concat_ws(' ', role, CAST(turn AS VARCHAR), CASE WHEN h <> '' THEN h END, 'end') AS text,
  CASE turn % 3 WHEN 0 THEN array_to_string(string_split(plain, ' '), '|') WHEN 1 THEN trim(plain) ELSE '' END AS listed FROM d""",
    "text_tidied": "SELECT conv_id, turn, role FROM conversations",
    "describe_values": "WITH v AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME \"column\" VALUE x)\n"
    "SELECT \"column\", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS max FROM v GROUP BY 1",
    "value_pivot": f"SELECT source, {', '.join(f"nullif(count(*) FILTER (lang = '{x}'), 0) AS {x}" for x in ('en', 'fr', 'de', 'es'))} FROM documents GROUP BY source",
    "user_prompts": "SELECT conv_id, turn, CASE WHEN role = 'user' AND text <> '' THEN role || ': ' || text ELSE '[' || role || ' waits at ' || turn || ']' END AS user_prompt FROM conversations",
}



def _lloyd_round(i: int) -> str:
    """Assignments to the centroids of a round, and their means."""
    return f"""a{i} AS (SELECT k, s, vec_id, any_value(e.v) AS v, min(struct_pack(d := pow(list_distance(e.v, c.v), 2), cluster := cluster)).cluster AS cluster FROM e, c{i} c GROUP BY k, s, vec_id),
n{i} AS (SELECT k, s, cluster, list(x ORDER BY pos) AS v, any_value(n) AS n FROM (
  SELECT k, s, cluster, pos, avg(x) AS x, count(*) AS n FROM (SELECT k, s, cluster, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM a{i}) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS (SELECT k, s, cluster, coalesce(n.v, c.v) AS v, coalesce(n.n, 0) AS n FROM c{i} c LEFT JOIN n{i} n USING (k, s, cluster))"""


def lloyd_models(ks: tuple[int, ...], starts: tuple[int, ...], rounds: int) -> str:
    return f"""WITH {_E}, m AS (SELECT k, s FROM unnest({list(ks)}) a(k), unnest({list(starts)}) b(s)),
c0 AS (SELECT k, s, r - 1 AS cluster, v FROM (SELECT k, s, v, row_number() OVER (PARTITION BY k, s ORDER BY md5(s || '|' || vec_id)) AS r FROM e, m) WHERE r <= k),
{", ".join(map(_lloyd_round, range(rounds)))}
SELECT k || '-' || s AS model, cluster, n, round(list_sum(v), 6) AS total, round(list_inner_product(v, v), 6) AS square FROM c{rounds}"""


SQL["threshold_join"] = f"""WITH {_E}, d AS (SELECT min(vec_id) AS id, count(*) AS n, v FROM e GROUP BY v), u AS (SELECT id, n, {_added("v")} AS v FROM d)
SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 6) AS sim, a.n AS a_copies, b.n AS b_copies FROM u a JOIN u b ON a.id < b.id AND list_inner_product(a.v, b.v) >= 0.4"""
SQL["all_row_silhouette"] = f"""WITH {_E}, m AS ({_mean("e", "label")}), c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cluster, c FROM m),
a AS (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := list_distance(v, c), i := cluster)).i AS cluster FROM e, c GROUP BY vec_id),
p AS (SELECT x.vec_id, x.cluster AS own, y.cluster AS other, sum(pow(list_distance(x.v, y.v), 2)) AS d, count(*) AS n FROM a x, a y GROUP BY ALL),
s AS (SELECT vec_id, max(n) FILTER (own = other) AS n, max(d / greatest(n - 1, 1)) FILTER (own = other) AS i, min(d / n) FILTER (own <> other) AS o FROM p GROUP BY vec_id)
SELECT cluster, count(*) AS n, (SELECT round(avg(CASE WHEN n > 1 AND o IS NOT NULL THEN (o - i) / greatest(o, i, 1e-300) ELSE 0 END), 6) FROM s) AS silhouette FROM a GROUP BY cluster"""
SQL["row_ordinals"] = "SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS ord FROM documents"
SQL["literal_lists"] = f"SELECT conv_id, turn, CAST(len(w) + 3 AS BIGINT) AS n, array_to_string(list_concat(w, ['None', 'it''s', '7']), '|') AS items FROM (SELECT conv_id, turn, {_TOKENS.format('text')} AS w FROM conversations)"

_TYPE = "CASE tag " + " ".join(f"WHEN {_literal(t)} THEN {i}" for t, i in selection.TAG_TYPES.items()) + " ELSE 1 END"
_PANELS = f"""pan AS (SELECT request_id, (request_id // 10) % 7 AS scenario, (request_id // 10) // 7 AS repeat, position AS ordinal, slot, card_id, arch, tag, {_TYPE} AS type FROM ({_panel(False)})),
ans AS (SELECT *, CASE type {" ".join(f"WHEN {k} THEN {_literal(v)}" for k, v in ANSWERS.items())} END AS text FROM pan)"""
_SCORED = f"{_lexical('ans', 'request_id', 'ordinal', 'text')}, sc AS (SELECT request_id, avg(dist) AS m FROM pairs GROUP BY request_id)"
_TRIALS = f"""{_PANELS}, {_SCORED}, tr AS (SELECT scenario, repeat, coalesce(any_value(m), 0) AS diversity, count(*) AS n_valid, array_to_string(list_sort(list(type)), ',') AS types, count(DISTINCT type) AS k, CAST(sum(card_id % 17) AS DOUBLE) AS t_total
  FROM ans LEFT JOIN sc USING (request_id) GROUP BY scenario, repeat)"""
SQL["ivf_exact"] = SQL["exact_topk"]
SQL["neighbour_graph"] = f"""WITH {_E}, u AS (SELECT vec_id, {_unit("v")} AS v FROM e),
s AS (SELECT p.vec_id AS id, q.vec_id AS other, list_inner_product(p.v, q.v) AS c FROM u p, u q WHERE p.vec_id <> q.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS r FROM s QUALIFY r <= 10),
l AS (SELECT id, list(other ORDER BY r) AS others, list(greatest(0.0, 1 - c) ORDER BY r) AS d FROM n GROUP BY id),
h AS (SELECT *, coalesce(list_min(list_filter(d, lambda y: y > 0)), 0.0) AS rho FROM l),
g AS (SELECT *, list_reduce(list_concat([CAST(-5 AS DOUBLE)], list_transform(range(1, 41), lambda i: 15.0 / pow(2.0, i))),
  lambda x, t: x + t * CASE WHEN list_sum(list_transform(d, lambda y: exp(-greatest(0.0, y - rho) / pow(2.0, x)))) < log2(10) THEN 1 ELSE -1 END) AS scale FROM h),
p AS (SELECT id, unnest(others) AS other, unnest(list_transform(d, lambda y: exp(-greatest(0.0, y - rho) / pow(2.0, scale)))) AS w FROM g)
SELECT least(id, other) AS a, greatest(id, other) AS b, round(1 - product(1 - w), 6) AS weight FROM p GROUP BY 1, 2"""
SQL["affinity_tag_major"] = SQL["affinity_scores"]
SQL["table_answers"] = f"WITH {_PANELS} SELECT request_id, ordinal, type, text FROM ans"
SQL["trial_table"] = f"WITH {_TRIALS} SELECT scenario, repeat, round(diversity, 6) AS diversity, 'self_bleu' AS method, diversity >= 0.25 AS passed, n_valid, types, k AS n_distinct_types, t_total FROM tr"
_MEASURE = "SELECT coalesce(CAST(scenario AS VARCHAR), 'ALL') AS scenario, '{0}' AS measure, count(*) AS n_trials, round(avg(CASE WHEN diversity >= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(CASE WHEN k = 3 THEN 1.0 ELSE 0.0 END), 6) AS distinct_type_rate, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95, round(min({0}), 6) AS min, round(max({0}), 6) AS max FROM tr GROUP BY ROLLUP (scenario)"
SQL["trial_report"] = f"WITH {_TRIALS} {_MEASURE.format('diversity')} UNION ALL {_MEASURE.format('t_total')}"
SQL["results_json"] = f"""WITH {_PANELS}, {_SCORED} SELECT request_id, '{{"scenario":{{"scenario":' || scenario || ',"repeat":' || repeat || '}},"diversity":{{"mean_score":' || CAST(round(coalesce(any_value(m), 0), 4) AS VARCHAR) || ',"passed":' || (coalesce(any_value(m), 0) >= 0.25)
  || ',"threshold":0.25}},"mentors":[' || string_agg('{{"slot":"' || slot || '","card_id":' || card_id || ',"tag":"' || tag || '","type":' || type || ',"text":"' || text || '"}}', ',' ORDER BY ordinal) || ']}}' AS json
FROM ans LEFT JOIN sc USING (request_id) GROUP BY request_id, scenario, repeat"""


def system_prompts(sections: list[tuple[int, str]], guides: dict[int, tuple[str, str]]) -> str:
    """The sections with their places filled by ``replace``."""
    values = {
        "name": "'card ' || card_id", "arch": "arch", "child": "'a child of ten'", "memories": "'  * saw ' || item || chr(10) || '  * has a friend'", "item": "item", "category": "category", "price": "format('{:,}', price)", "type": "CAST(type AS VARCHAR)",
        "style": "CASE type " + " ".join(f"WHEN {k} THEN {_literal(v[0])}" for k, v in guides.items()) + " END", "guide": "CASE type " + " ".join(f"WHEN {k} THEN {_literal(v[1])}" for k, v in guides.items()) + " END",
    }
    text = _literal("\n\n".join(t for _, t in sorted(sections)))
    for k, v in values.items():
        text = f"replace({text}, '{{{k}}}', {v})"
    scenes = ", ".join(f"({n}, {_literal(c)}, {_literal(i)}, {p})" for n, (_, c, _, i, p) in enumerate(SCENARIOS[:7]))
    return f"WITH {_PANELS} SELECT request_id, ordinal, type, {text} AS prompt FROM pan JOIN (VALUES {scenes}) t(scenario, category, item, price) USING (scenario)"


def _two_directions(rows: str, row: str, column: str) -> str:
    """Tables ``b2``, two orthogonal directions after two rounds from signs, the first of unit length, and ``h``, the second's squared length; ``rows`` has ``x``."""
    sign = lambda j: f"CASE WHEN substr(md5('42|' || {column} || '|{j}'), 1, 1) < '8' THEN 1.0 ELSE -1.0 END"
    text = f"b0 AS (SELECT {column}, {sign(0)} AS y0, {sign(1)} AS y1 FROM (SELECT DISTINCT {column} FROM {rows}))"
    for i in (0, 1):
        text += f""", p{i} AS (SELECT {row}, sum(x * y0) AS p, sum(x * y1) AS q FROM {rows} JOIN b{i} USING ({column}) GROUP BY {row}),
c{i} AS (SELECT {column}, sum(x * p) AS y0, sum(x * q) AS y1 FROM {rows} JOIN p{i} USING ({row}) GROUP BY {column}), g{i} AS (SELECT sum(y0 * y0) AS a, sum(y0 * y1) AS b FROM c{i}),
b{i + 1} AS (SELECT {column}, y0 / sqrt(a) AS y0, y1 - b / a * y0 AS y1 FROM c{i}, g{i})"""
    return text + ", h AS (SELECT sum(y1 * y1) AS c FROM b2)"


def fitted_encoder(buckets: int) -> str:
    bucket = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {buckets}"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({lower}, '[\\t-\\r ]+'), lambda x: x <> '')) AS w FROM documents),
t AS (SELECT doc_id, {bucket} AS term, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS rarity FROM t GROUP BY term),
u AS (SELECT doc_id, term, n * rarity AS x FROM t JOIN r USING (term)), d AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM u),
{_two_directions("d", "doc_id", "term")}, o AS (SELECT doc_id, sum(x * y0) AS p, sum(x * y1) AS q FROM d JOIN b2 USING (term) GROUP BY doc_id)
SELECT doc_id, round(coalesce(p * p + q * q / c, 0), 6) AS kept FROM documents LEFT JOIN o USING (doc_id), h"""


def request_batches(token_cap: int, request_cap: int) -> str:
    half = token_cap // 2
    return f"""WITH t AS (SELECT doc_id, CAST(len({_TOKENS.format("text")}) + 50 AS BIGINT) AS tokens FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS ord, coalesce(sum(CASE WHEN tokens <= {half} THEN tokens END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
c AS (SELECT *, CASE WHEN tokens <= {half} THEN 's' || CAST(before // {token_cap - half + 1} AS BIGINT) ELSE 'l' || ord END AS cut FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY ord) - 1 AS i FROM c)
SELECT doc_id, tokens, cut || '-' || (i // {request_cap}) AS batch, i % {request_cap} AS place FROM n"""


_CENTRED = f"{_E}, a AS ({_ALL}), m AS (SELECT pos, avg(x) AS m FROM a GROUP BY pos), d AS (SELECT vec_id, pos - 1 AS pos, x - m AS x FROM a JOIN m USING (pos))"
SQL |= {
    "randomised_pca": f"""WITH {_CENTRED}, {_two_directions("d", "vec_id", "pos")},
o AS (SELECT vec_id, sum(x * x) AS s, sum(x * y0) AS p, sum(x * y1) AS q FROM d JOIN b2 USING (pos) GROUP BY vec_id), k AS (SELECT *, p * p + q * q / c AS kept FROM o, h)
SELECT vec_id, round(s - kept, 6) AS residual, round((SELECT sum(kept) / sum(s) FROM k), 6) AS captured FROM k""",
    "label_residuals": f"""WITH {_E}, a AS ({_ALL}), d AS (SELECT vec_id, pos, x - avg(x) OVER (PARTITION BY label, pos) AS x FROM a)
SELECT vec_id, round(sqrt(sum(x * x)), 6) AS residual_norm, round(max(x) FILTER (pos = 1), 6) AS first, round(max(x) FILTER (pos = 64), 6) AS last FROM d GROUP BY vec_id""",
    "component_variances": f"""WITH {_CENTRED}, n AS (SELECT count(*) AS n FROM e), c AS (SELECT i.pos AS i, j.pos AS j, sum(i.x * j.x) / any_value(n) AS c FROM d i JOIN d j USING (vec_id), n GROUP BY ALL)
SELECT CAST(64 AS BIGINT) AS n, round(sum(c) FILTER (i = j), 6) AS total, round(sum(c * c), 6) AS square FROM c""",
    "incremental_centroids": f"""WITH {_E}, a AS ({_ALL}) SELECT label AS cluster, count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM a WHERE label IS NOT NULL GROUP BY ALL""",
    "collected_answers": """WITH a AS (SELECT text, conv_id % 50 AS batch, conv_id, turn FROM conversations WHERE turn % 5 <> 4 AND (conv_id % 50) % 7 <> 3)
SELECT text, batch, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY batch, conv_id, turn) AS r FROM a) WHERE r = 1""",
}
