"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is one projection of built-in functions: no shuffle, no Python on the executors.
Patterns are written so that a text of any length takes linear time: what a run of
characters has failed to match is not tried again from the run's inside. (``\\G`` allows a
match to start where the last one ended, which is the only such place inside a run.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

#: Length of account numbers by country, as in the registry and in use besides it.
IBAN_LENGTHS = {
    w[:2]: int(w[2:])
    for w in """AD24 AE23 AL28 AO25 AT20 AZ28 BA20 BE16 BF28 BG22 BH22 BI27 BJ28 BL27 BR29 BY28 CF27 CG27 CH21 CI28 CM27 CR22 CV25 CY28 CZ24 DE22
    DJ27 DK18 DO28 DZ26 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GA27 GB22 GE22 GF27 GI23 GL18 GP27 GQ27 GR27 GT28 GW25 HN28 HR21 HU28 IE22
    IL23 IQ23 IR26 IS26 IT27 JO30 KM27 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MA28 MC27 MD24 ME22 MF27 MG27 MK19 ML28 MN20 MQ27
    MR27 MT31 MU30 MZ25 NC27 NE28 NI28 NL18 NO15 OM23 PF27 PK24 PL28 PM27 PS29 PT25 QA29 RE27 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19
    SK24 SM27 SN28 SO23 ST25 SV28 TD27 TF27 TG28 TL23 TN24 TR26 UA29 VA22 VG24 WF27 XK20 YE30 YT27""".split()
}


def _iban() -> str:
    """Spans of just the length that their country has, so that a word or number behind one is no part of it."""
    of = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
    return r"\b(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in of.items()) + r")\b"


PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
}
#: A text without this character or pattern cannot hold the kind.
NEEDS = {"email": "@", "phone": "+"}
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
#: Words that raise a span's score, and words that lower it, where one stands whole within ``REACH`` characters of it on either side.
RAISING = {
    "email": "mail|mails|email|contact|write|address|correo|courriel",
    "ip": "ip|host|server|address|addr|adresse|login",
    "card": "card|cards|visa|mastercard|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|telefono|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
LOWERING = {
    "email": "noreply|postmaster",
    "ip": "version|release|section|chapter",
    "card": "isbn|order|tracking|serial",
    "phone": "isbn|order|tracking|serial",
    "iban": "serial|licence|license",
}
REACH, CHANGE = 48, 0.2
#: Numbers that are summed up one by one: running sums come from blocks of so many, and blocks of blocks.
_BLOCK = 64
#: Characters of a chunk, more than a context reaches, and chunks of a text, in linear time.
_CHUNK = 512


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, in time of its own length wherever it stands; what lies beyond the text is empty."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    head = F.substring(chunk(first), (start - first * _CHUNK + 1).cast("int"), F.least(end - start, F.lit(_CHUNK)).cast("int"))
    tail = F.substring(chunk(last), F.lit(1), (end - last * _CHUNK).cast("int"))
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(last <= first, head).otherwise(F.concat(head, middle, tail))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit doubled."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code leaves 1 modulo 97, its first four characters moved to the end, A as 10 to Z as 35."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _octet(part: Column) -> Column:
    """A number up to 255, leading zeros allowed, of however many digits."""
    short = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)


def valid(kind: str, match: Column) -> Column:
    """What a proposed span must fulfil besides its pattern."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), _octet)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n)


def _proposed(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
    return F.when(F.size(found) > 0, found)


def _whole(words: str) -> str:
    """A pattern for one of the words between characters that belong to no word."""
    return rf"[^\p{{L}}\p{{N}}_](?:{words})[^\p{{L}}\p{{N}}_]"


def _around(chunks: Column, start: Column, end: Column) -> Column:
    """What stands on either side of a span, in lower case, a line break for the span itself.

    One character more than ``REACH`` is read, so that a word cut off there is none of its
    own; the text's ends count as blanks.
    """
    before = _between(chunks, F.greatest(start - REACH - 1, F.lit(0)), start)
    after = F.rpad(_between(chunks, end, end + REACH + 1), REACH + 1, " ")
    return F.lower(F.concat(F.when(start <= REACH, " ").otherwise(""), before, F.lit("\n"), after))


def _spans(kind: str, at: dict[str, Column], chunks: Column) -> Column:
    """Array of ``(start, order, end, kind, score, valid)`` of the kind's valid spans, in code points, end exclusive."""

    def place(match: Column, i: Column) -> Column:
        block, wide = F.floor(i / _BLOCK).cast("int"), F.floor(i / _BLOCK**2).cast("int")
        before = _sum(F.slice(at["steps"], block * _BLOCK + 1, i % _BLOCK)) + _sum(F.slice(at["sums"], wide * _BLOCK + 1, block % _BLOCK))
        start = F.element_at(at["widest"], wide + 1) + before + F.get(at["gaps"], i)
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), valid(kind, match).alias("valid"))

    def span(x: Column) -> Column:
        near = _around(chunks, x["start"], x["end"])
        score = F.lit(SCORES[kind]) + F.when(near.rlike(_whole(RAISING[kind])), CHANGE).otherwise(0.0) - F.when(near.rlike(_whole(LOWERING[kind])), CHANGE).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), x["valid"].alias("valid"))

    return F.transform(F.filter(F.transform(at["matches"], place), lambda x: x["valid"]), span)


def detect(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with ``out``: array of ``(start, order, end, kind, score, valid)`` by start, then kind.

    Positions are code points of the text, ends exclusive. Per kind, the pattern's leftmost
    non-overlapping matches are proposed; those that fail the kind's check are dropped
    without another try. A null or empty text has an empty array. A column named ``out``
    or one whose name begins with ``__pii_`` is replaced. Rows are independent: ties,
    repeated rows and an empty table need no care.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda kind, part: f"__pii_{kind}_{part}"
    # Where matches stand: what lies between them comes from a split by the same pattern,
    # and running sums are taken over blocks and within them, and contexts from chunks of
    # the text, so that a text with very many matches does not cost the square of their number.
    df = df.withColumns({name(k, "matches"): _proposed(text, k) for k in KINDS})
    df = df.withColumns(
        {
            name(k, "gaps"): F.when(
                F.col(name(k, "matches")).isNotNull(),
                F.transform(F.split(text, PATTERNS[k], -1), lambda g: F.length(g)),
            )
            for k in KINDS
        }
    )
    df = df.withColumns(
        {
            name(k, "steps"): F.zip_with(
                F.slice(F.col(name(k, "gaps")), F.lit(1), F.size(F.col(name(k, "matches")))),
                F.col(name(k, "matches")),
                lambda g, m: g + F.length(m),
            )
            for k in KINDS
        }
    )
    for part, of in (("sums", "steps"), ("wider", "sums")):
        df = df.withColumns({name(k, part): _block_sums(F.col(name(k, of))) for k in KINDS})
    df = df.withColumns({name(k, "widest"): _sums_before(F.col(name(k, "wider"))) for k in KINDS})
    any_kind = F.coalesce(*(F.size(F.col(name(k, "matches"))) for k in KINDS)).isNotNull()
    df = df.withColumn("__pii_chunks", F.when(any_kind, _chunks(text)))
    parts = ("matches", "gaps", "steps", "sums", "wider", "widest")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double,valid:boolean>>")
    found = [F.coalesce(_spans(k, {p: F.col(name(k, p)) for p in parts}, F.col("__pii_chunks")), none) for k in KINDS]
    return df.withColumn(out, F.array_sort(F.concat(*found))).drop("__pii_chunks", *(name(k, p) for k in KINDS for p in parts))


def _block_sums(numbers: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _sum(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK))))


def _sums_before(numbers: Column) -> Column:
    return F.transform(numbers, lambda _, i: _sum(F.slice(numbers, F.lit(1), i)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii", least: float = 0.0) -> DataFrame:
    """``df`` with each span of score ``least`` or more replaced by its kind in angle brackets.

    Overlapping spans are cut at the end of the one before; a span within another adds
    nothing. A null text becomes empty. Spans are folded in blocks, so that very many of them
    in one text do not cost the square of their number.
    """
    chosen, chunks, blocks = F.col("__pii_chosen"), F.col("__pii_chunks"), F.sequence(F.lit(0), F.floor(F.size("__pii_chosen") / _BLOCK).cast("int"))

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(a["done"], _between(chunks, a["at"], F.greatest(x["start"], a["at"])), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["end"] <= a["at"], a).otherwise(F.struct(piece.alias("done"), F.greatest(x["end"], a["at"]).alias("at")))

    def block(a: Column, i: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), a["at"].alias("at"))
        one = F.aggregate(F.slice(chosen, i * _BLOCK + 1, F.lit(_BLOCK)), start, step)
        return F.struct(F.concat(a["done"], F.array(one["done"])).alias("done"), one["at"].alias("at"))

    rest = lambda a: F.concat(F.array_join(a["done"], ""), _between(chunks, a["at"], F.col("__pii_length")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = df.withColumns({"__pii_chosen": F.filter(spans_col, lambda x: x["score"] >= least), "__pii_chunks": _chunks(text), "__pii_length": F.length(text)})
    return parts.withColumn(text_col, F.aggregate(blocks, start, block, rest)).drop("__pii_chosen", "__pii_chunks", "__pii_length")
