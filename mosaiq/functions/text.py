"""Column expressions on texts and lists of texts."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word, as Python's ``str.split`` has them.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"
#: White space at either end.
ENDS = f"^{SPACE}|{SPACE}$"
LEAST_CHARS, MOST_CHARS = 20, 300
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())
SENTENCE_ENDS = "。!?."


def tokens(text: Column) -> Column:
    """Words between white space, empty ones left out; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def term_buckets(text: Column, buckets: int) -> Column:
    """Each word's bucket, repeats included: the first 8 hex digits of its MD5 digest modulo ``buckets``.

    Words are runs of other characters than a space and tab to carriage return, A-Z in lower case.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    words = F.filter(F.split(plain, r"[\t-\r ]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(buckets)))


def terms_of(text: str, buckets: int) -> list[int]:
    """As :func:`term_buckets`, of one text within a task."""
    words = re.split(r"[\t-\r ]+", text.translate(_LOWER))
    return [_hashed(w) % buckets for w in words if w]


@lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def counted_terms(texts: pa.Array, buckets: int, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text the number of its different terms, and one after the other these terms in order and how often each occurs.

    Terms are those of :func:`term_buckets`; a null text has none. Some ``most`` bytes are
    counted at a time, a whole text at least; each different word of them is hashed once.
    """
    ends, at, parts = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0, []
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, to - at), "")))
        coded = words.flatten().dictionary_encode()
        listed = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.frombuffer(b"".join(hashlib.md5(w).digest() for w in listed), ">u4")[::4]
        bucket = np.where([w == b"" for w in listed], -1, hashes.astype(np.int64) % buckets)[coded.indices.to_numpy()]
        row = np.repeat(np.arange(to - at), np.diff(words.offsets.to_numpy()))
        keys = np.sort((row * buckets + bucket)[bucket >= 0])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        row, term = np.divmod(keys[first], buckets)
        parts.append((np.bincount(row, minlength=to - at), term, np.diff(first, append=len(keys))))
        at = to
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, dtype=np.int64),) * 3


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, space-joined; the list of words is evaluated once, not once a run."""
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= n, runs(ws)).otherwise(F.array().cast("array<string>")))[0]


def _last(text: Column, c: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(text), c)
    return F.when(back == 0, -1).otherwise(F.length(text) - back)


def postprocess(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """Struct ``(text, is_valid, issue)``: too short is an issue, too long is cut after a sentence, or else hard.

    The cut is after the last sentence end among the first ``most`` characters, if its
    place is beyond ``least``. A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, most)
    last = F.greatest(*(_last(head, c) for c in SENTENCE_ENDS))
    cut = F.when(F.length(text) <= most, text).when(last > least, F.substring(head, F.lit(1), last + 1)).otherwise(head)
    valid = F.length(text) >= least
    issue = F.when(~valid, F.concat(F.lit("too short ("), F.length(text), F.lit(")")))
    return F.struct(cut.alias("text"), valid.alias("is_valid"), issue.alias("issue"))


def joined(parts: list[Column], by: str) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(by, *(F.nullif(p, F.lit("")) for p in parts))


def labelled(parts: dict[str, Column], by: str = " | ") -> Column:
    """``label: value`` of each part that is neither null nor empty, joined."""
    return F.concat_ws(by, *(F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()))


def persona_text(summary: Column, career: Column, culture: Column, culinary: Column, hobbies: Column, tag: Column) -> Column:
    return joined([summary, career, culture, culinary, F.array_join(hobbies, " "), tag], " ")


#: An item of a list written as a literal: a quoted text with escapes, nothing, a truth value or a plain number; loops that never give back.
_ITEM = r"""(?s)'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\bNone\b|\bTrue\b|\bFalse\b|-?\b(?:0|[1-9][0-9]*+)(?:\.(?:[0-9]*[1-9]|0))?(?![0-9.])"""
#: What stands for an item where only the rest of the list is looked at.
_MARK = "\x01"
#: Parts of a quoted text: escapes by code in hex or octal, other escapes, and runs of anything else.
_ESCAPED = r"(?s)\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-7]{1,3}|\\.|[^\\]++"
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}


def _unescaped(part: Column) -> Column:
    kind, rest = F.substring(part, 2, 1), F.substring(part, 3, 16)
    code = F.when(kind.isin("x", "u", "U"), rest).when(kind.rlike("[0-7]"), F.conv(F.substring(part, 2, 3), 8, 16))
    coded = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    other = F.coalesce(lookup(kind, _PLAIN), F.when(kind.isin("'", '"', "\\"), kind), part)
    return F.when(~part.startswith("\\"), part).when(part.rlike(r"^\\(?:x[0-9A-Fa-f]|u[0-9A-Fa-f]|U[0-9A-Fa-f]|[0-7])"), coded).otherwise(other)


def _literal_item(item: Column) -> Column:
    inner = F.substring(item, F.lit(2), F.length(item) - 2)
    parts = F.transform(F.regexp_extract_all(inner, F.lit(_ESCAPED), F.lit(0)), _unescaped)
    text = F.when(F.contains(inner, F.lit("\\")), F.array_join(parts, "")).otherwise(inner)
    return F.regexp_replace(F.when(item.rlike("^['\"]"), text).otherwise(item), ENDS, "")


def list_or_string(value: Column) -> Column:
    """A list given as text: its items as texts without white space at their ends; other text is the one item itself, and no text is an empty list.

    A list is written as Python writes one of quoted texts, ``None``, truth values and plain
    numbers, escapes and both kinds of quotes included. What begins like one and is not is
    one item. Whatever its length, a text takes linear time.
    """
    text = F.regexp_replace(F.coalesce(value, F.lit("")), ENDS, "")
    items = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    # Without its items a list is marks between commas, perhaps with one behind the last.
    rest = F.regexp_replace(F.regexp_replace(text, _ITEM, _MARK), r"\s", "")
    places = F.split(F.substring(rest, F.lit(2), F.length(rest) - 2), ",")
    held = F.when(F.element_at(places, -1) == "", F.slice(places, F.lit(1), F.size(places) - 1)).otherwise(places)
    sound = rest.startswith("[") & rest.endswith("]") & (F.length(rest) > 1) & (F.size(held) == F.size(items)) & F.forall(held, lambda x: x == _MARK)
    return F.when(text == "", F.array().cast("array<string>")).when(sound, F.transform(items, _literal_item)).otherwise(F.array(text))


def truthy(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def first_keyword(text: Column, keywords: list[str], default: str | None = None) -> Column:
    """The first of the keywords, in their own order, that the text contains."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords), F.lit(default))


def head_replaced(text: Column, replace: dict[str, str], default: str) -> Column:
    """What stands before the first comma, with replacements made in order; ``default`` if that is empty."""
    head = F.trim(F.get(F.split(F.coalesce(text, F.lit("")), ","), F.lit(0)))
    head = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), replace.items(), head)
    return F.coalesce(F.nullif(head, F.lit("")), F.lit(default))


def lookup(key: Column, values: dict, default: object = None) -> Column:
    """A constant table's value for the key."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def age_band(age: Column, oldest: bool = False) -> Column:
    """Bands from 19, 30 and 50 years on, and from 70 where ``oldest`` asks for it; ``other`` else."""
    band = F.when(age.between(19, 29), "19-29").when(age.between(30, 49), "30-49").when(age.between(50, 69), "50-69")
    return (band.when(age >= 70, "70+") if oldest else band).otherwise("other")


def number_mode(value: Column) -> Column:
    """Thousands separated by commas, no decimals."""
    return F.format_number(value, 0)
