"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontamination, embedding_dedup, exact_dedup, html_text, langid, mixing, packing, pii, resampling, sharding, simhash, vector_codes, warc
from mosaiq.llm._common import table
from mosaiq.llm._terms import TERM

#: Production parameters of op1: a hundred slots a shard keep the shares within a percent.
N_SHARDS, N_SLOTS = 64, 6553


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, "doc_id", sharding.shard_names(N_SHARDS), N_SLOTS).select("doc_id", "slot", "shard")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda x: x["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("size") * F.size("shards")).alias("taken")
    return mixing.plan(table(spark, sf_dir, "documents")).select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", taken)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that language models may not learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def vocabulary() -> str:
    """The vocabulary file that op9 counts with; it stays where its package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = F.col("hits")
    return decontamination.scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_decontamination": op12_decontamination,
    "op13_resampling": op13_resampling,
}

_OP1 = f"""
WITH RECURSIVE
names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 5, '0') AS shard FROM range({N_SHARDS}) t(i)),
prefs AS (
  SELECT i, shard,
    CAST(('0x' || substr(md5('offset|' || shard), 1, 15)) AS BIGINT) % {N_SLOTS} AS o,
    CAST(('0x' || substr(md5('skip|' || shard), 1, 15)) AS BIGINT) % ({N_SLOTS} - 1) + 1 AS s
  FROM names),
lists AS (SELECT list(o ORDER BY i) AS o, list(s ORDER BY i) AS s FROM prefs),
turns AS (
  SELECT 0 AS t, list_transform(range({N_SLOTS}), lambda x: -1) AS tab, CAST(NULL AS BIGINT) AS slot
  UNION ALL
  SELECT t + 1, list_concat(list_concat(tab[:c], [t % {N_SHARDS}]), tab[c + 2:]), c
  FROM (
    SELECT t, tab, (a + b * list_filter(range({N_SLOTS}), lambda j: tab[(a + j * b) % {N_SLOTS} + 1] < 0)[1]) % {N_SLOTS} AS c
    FROM (SELECT t, tab, o[t % {N_SHARDS} + 1] AS a, s[t % {N_SHARDS} + 1] AS b FROM turns, lists WHERE t < {N_SLOTS})
  )
),
owner AS (SELECT slot, (t - 1) % {N_SHARDS} AS i FROM turns WHERE slot IS NOT NULL)
SELECT d.doc_id, d.slot, n.shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {N_SLOTS} AS slot FROM documents) d
JOIN owner o ON o.slot = d.slot JOIN names n ON n.i = o.i
"""

_OP2 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

#: The patterns as their contract has them, without what keeps Java's engine linear.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(rf"{country}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for country, n in pii.IBAN_LENGTHS.items()) + r")\b",
}
#: By kind the score without context, the words that raise it and those that lower it by 0.2, whole, up to 48 characters away.
_CONTEXT = {
    "email": (0.9, "address|contact|correo|courriel|email|mail|mails|write", "noreply|postmaster"),
    "ip": (0.5, "addr|address|adresse|host|ip|login|server", "chapter|release|section|version"),
    "card": (0.7, "card|cards|carte|credit|debit|karte|mastercard|payment|tarjeta|visa", "isbn|order|serial|tracking"),
    "phone": (0.6, "call|fax|llame|mobile|phone|tel|telefon|telefono|telephone", "isbn|order|serial|tracking"),
    "iban": (0.8, "account|bank|compte|cuenta|iban|konto", "licence|license|serial"),
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
_CODE = "replace(m, ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split(substr({_CODE}, 5) || substr({_CODE}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(substr(ltrim(p, '0'), 1, 3) AS INTEGER), 0) > 255)) = 0",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"CASE WHEN length({_CODE}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END",
}


def _op3_kind(kind: str) -> str:
    """Spans of one kind: matches, and the lengths of what lies between them, summed up."""
    base, up, down = _CONTEXT[kind]
    near = "lower(CASE WHEN st < 49 THEN ' ' ELSE '' END || t[greatest(st - 48, 1):st] || chr(10) || t[st + length(m) + 1:st + length(m) + 49] || CASE WHEN length(t) - st - length(m) < 49 THEN ' ' ELSE '' END)"
    has = lambda words: f"CAST(regexp_matches({near}, '[^\\p{{L}}\\p{{N}}_](?:{words})[^\\p{{L}}\\p{{N}}_]') AS INTEGER)"
    score = f"least(1.0, {base} + 0.2 * {has(up)} - 0.2 * {has(down)})"
    return f"""SELECT doc_id, st, {pii.KINDS.index(kind)} AS o, st + length(m) AS e, '{kind}' AS kind, {score} AS score FROM (
  SELECT doc_id, t, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS st FROM (
    SELECT doc_id, t, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, t, regexp_extract_all(t, '{_PATTERNS[kind]}') AS ms, string_split_regex(t, '{_PATTERNS[kind]}') AS gs FROM d))) WHERE {_VALID[kind]}"""


_LIST = "string_agg(kind || ':' || st || ':' || e, ',' ORDER BY st, o)"
_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(map(_op3_kind, pii.KINDS))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
  string_agg(kind || ':' || st || ':' || e, ',' ORDER BY st, o) FILTER (kind <> 'iban') AS base, {_LIST} AS spans, string_agg(printf('%.2f', score), ',' ORDER BY st, o) AS scores FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)
"""
_H60 = "CAST(('0x' || substr(md5(%s), 1, 15)) AS BIGINT)"
_OP6 = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
r AS (SELECT *, {mixing.CAP} * source_size AS lim, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM s),
o AS (SELECT *, row_number() OVER w AS turn,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER b, 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW w AS (ORDER BY lim / weight, source NULLS LAST), b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(lim AS DOUBLE), weight * (SELECT level FROM o WHERE level <= lim / weight ORDER BY turn LIMIT 1)) AS target,
    {mixing.BLOCKS} AS n_blocks FROM o),
f AS (SELECT d.doc_id, d.size, t.* , {_H60 % f"'block|{mixing.SEED}|' || CAST(doc_id AS VARCHAR)"} % n_blocks AS block FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words, min(target) - floor(min(target) / greatest(min(source_size), 1)) * min(source_size) AS lft,
    row_number() OVER (PARTITION BY source ORDER BY {_H60 % f"'order|{mixing.SEED}|' || coalesce(source, '') || '|' || CAST(block AS VARCHAR)"}, block) AS i
  FROM f GROUP BY source, block),
g AS (
  SELECT source, block, i, CASE WHEN words <= lft THEN lft - words ELSE lft END AS rest, CAST(words <= lft AS INTEGER) AS more FROM k WHERE i = 1
  UNION ALL
  SELECT k.source, k.block, k.i, CASE WHEN k.words <= g.rest THEN g.rest - k.words ELSE g.rest END, CAST(k.words <= g.rest AS INTEGER)
  FROM g JOIN k ON k.source IS NOT DISTINCT FROM g.source AND k.i = g.i + 1)
SELECT f.doc_id, f.size, f.source_size, f.target, CAST(f.size * (floor(f.target / greatest(f.source_size, 1)) + g.more) AS BIGINT) AS taken
FROM f JOIN g ON g.source IS NOT DISTINCT FROM f.source AND g.block = f.block
"""

_OP10 = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id > f THEN f END AS refers_to
FROM q
"""

_N, _K = vector_codes.PARTS, vector_codes.ENTRIES


def _op11_round(i: int) -> str:
    """Assignments under the books of a round, and the books that follow."""
    last = i == vector_codes.ROUNDS
    return f"""a{i} AS (SELECT vec_id, part, min(struct_pack(far := list_sum(list_transform(x, lambda c, j: (c - e[j]) * (c - e[j]))), entry := entry, e := e)) AS best
  FROM parts JOIN b{i} USING (part) GROUP BY vec_id, part)""" + ("" if last else f""",
m{i} AS (SELECT part, entry, pos, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS mean FROM (
  SELECT part, best.entry AS entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM parts JOIN a{i} USING (vec_id, part)) GROUP BY part, entry, pos),
b{i + 1} AS (SELECT part, entry, coalesce(n.e, b{i}.e) AS e FROM b{i} LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS e FROM m{i} GROUP BY part, entry) n USING (part, entry))""")


_OP11 = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, q[part * (len(q) // {_N}) + 1 : (part + 1) * (len(q) // {_N})] AS x FROM kept, range({_N}) t(part)),
b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS e FROM parts QUALIFY entry < {_K}),
{", ".join(map(_op11_round, range(vector_codes.ROUNDS + 1)))},
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS}),
codes AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best.entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
_L = decontamination.WINDOW
_OP12 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
n AS (SELECT item_id, w, CAST(least(len(w), {_L}) AS BIGINT) AS size FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, size, array_to_string(w[st : st + size - 1], ' ') AS win FROM n, unnest(range(1, len(w) - size + 2)) t(st)),
f AS (SELECT DISTINCT doc_id, st, size, array_to_string(w[st : st + size - 1], ' ') AS win FROM d, (SELECT DISTINCT size FROM n), unnest(range(1, len(w) - size + 2)) t(st)),
h AS (SELECT DISTINCT doc_id, st, size, item_id FROM f JOIN s USING (win, size)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(st, st + size)) AS p FROM (SELECT DISTINCT doc_id, st, size FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: CRC-32 by its table of 256, which comes from its polynomial by eight halvings a byte.
_HALVE = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
_R = resampling
_OP13 = f"""
WITH RECURSIVE
t(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, {_HALVE.format(x="c")}, k + 1 FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents),
f AS MATERIALIZED (SELECT true AS doc, doc_id, unnest(w) AS word FROM d UNION ALL SELECT false, item_id, unnest({_TERMS}) FROM benchmark),
u AS MATERIALIZED (SELECT DISTINCT word FROM f),
bytes AS (SELECT word, tab, list_transform(range(len(hex(word)) // 2), lambda j: CAST('0x' || substr(hex(word), 2 * j + 1, 2) AS BIGINT)) AS b FROM u, tab),
crc AS MATERIALIZED (SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % {_R.BUCKETS} AS bucket FROM bytes),
g AS MATERIALIZED (SELECT bucket, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM f JOIN crc USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor({_R.UNIT} * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM g) + {_R.BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM g) + {_R.BUCKETS})))) AS BIGINT) AS gain FROM g),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN crc USING (word) JOIN gains USING (bucket) WHERE doc GROUP BY doc_id),
e AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST('0x' || substr(sha256('{_R.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d),
r AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, CAST(coalesce(weight, 0) + floor(-{_R.UNIT} * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS turn, count(*) OVER () AS n FROM r WHERE n_features >= {_R.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN turn <= {_R.PERCENT} * n // 100 THEN turn END AS rank FROM r LEFT JOIN o USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_pii": _OP3, "op10_warc": _OP10, "op6_mixing": _OP6, "op1_sharding": _OP1, "op2_exact_dedup": _OP2,
    "op11_vector_codes": _OP11, "op12_decontamination": _OP12, "op13_resampling": _OP13,
}
