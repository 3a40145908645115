"""The ten operators against brute force, and on awkward tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mosaiq.llm")

from mosaiq.llm import embedding_dedup, exact_dedup, html_text, langid, mixing, packing, pii, queries, sharding, simhash, tokens, warc  # noqa: E402
from mosaiq.llm._components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, white space, repeated texts and ties, other scripts, one long text.
TEXTS = [
    None, "", "   ", "a", "A  b", "a\tb", "a b", "The cat sat on the mat", "the cat  sat\non the mat", "Ünïcode ßtraße 漢字 é \x1c x", "1234 !!",
    "x" * 70_000, "the quick brown fox " * 3000, "!!!", "the quick brown fox " * 3000, " ", "a b",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s1", "s2", "s1"][i % 4], None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir, odd):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*odd.columns).union(odd.withColumn("doc_id", F.col("doc_id") + 100_000)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_empty_tables(spark, empty):
    clash = empty.withColumn("slot", F.lit(1)).withColumn("row_id", F.lit(1)).withColumn("size", F.lit(1)).withColumn("fp", F.lit(1)).withColumn("kept", F.lit(1)).withColumn("score", F.lit("x"))
    assert sharding.place(clash, "doc_id", ["a"], 7).count() == 0
    assert exact_dedup.exact_groups(clash).count() == 0
    assert pii.detect(clash).count() == 0
    assert simhash.near_groups(clash).count() == 0
    assert mixing.plan(clash).count() == 0
    assert packing.pack_documents(clash, queries.vocabulary()).count() == 0
    assert langid.predict(clash, langid.fit(clash)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharding(spark, odd):
    names = sharding.shard_names(5)
    table = sharding.lookup_table(names, 101)
    counts = Counter(table)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:4], 101)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 4)
    assert moved < 30  # most slots of the shards that stay keep their owner
    df = odd.withColumn("slot", F.lit("x")).withColumn("shard", F.lit(1)).union(odd.withColumn("slot", F.lit("x")).withColumn("shard", F.lit(1)))
    for r in rows_of(sharding.place(df, "text", names, 101)):
        slot = int(hashlib.md5((r["text"] or "").encode()).hexdigest()[:15], 16) % 101
        assert r["slot"] == slot and r["shard"] == names[table[slot]]
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] , 1 << 21)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def _normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[_normal(t)].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_dedup(docs):
    want = _exact([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = rows_of(exact_dedup.exact_groups(docs.withColumn("recipe", F.lit(1)).withColumn("keep_id", F.lit(1))))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want and len(got) == len(want)


def test_chunks_join_to_the_text(docs):
    norm = docs.select(exact_dedup.normalise(F.col("text")).alias("n"))
    for r in norm.select("n", exact_dedup.chunks(F.col("n")).alias("c")).collect():
        assert "".join(r["c"]) == r["n"]
        assert all(exact_dedup.MIN_CHUNK <= len(c) <= exact_dedup.MAX_CHUNK for c in r["c"][:-1])


def test_colliding_identifiers_are_told_apart(spark, monkeypatch):
    """With a hash of one bit almost all chunks collide, and the result is the same."""
    monkeypatch.setattr(exact_dedup, "chunk_hash", lambda c: F.xxhash64(c) % 2)
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.choice([1, 600]))) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(120)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == _exact(rows)


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (4, "b")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(-1, None, 3, True), (3, None, 3, False), (3, None, 3, False), (4, 4, 1, True)], key=str)


# Personal data

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _pii(text):
    out = []
    for o, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


_TRICKY = [
    "a@b.c@d.e _x@y.z a@b.c_d@e.f a@@b.c a@b a@b. a@b..c é@x.yz", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 41111111111111111111111 5-",
    "+1 (415) 555-2671 +44 20 7946 0958+49 30 901820 +1 +12 +123456789012345678 ++1 23456789", "漢字 📞 +1 (415) 555-2671 📧 x@y.zz", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 or GB82 WEST 1234 5698 7654 33",
    "a" * 60_000 + "@", "1 " * 20_000, ".".join("1" * 30_000), "a.b@" + ".".join(["c"] * 20_000), "+1" + " " * 40_000, "x@y.z " * 700,
]


def test_pii(spark, docs):
    tricky = spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(_TRICKY)], "doc_id long, text string")
    rng = random.Random(5)
    noise = [(300_000 + i, "".join(rng.choice("a1@.+- ()9_é") for _ in range(60))) for i in range(400)]
    df = docs.select("doc_id", "text").union(tricky).union(spark.createDataFrame(noise, "doc_id long, text string")).withColumn("pii", F.lit(1))
    base = F.filter("pii", lambda x: x["kind"] != "iban")
    for r in pii.detect(df).select("text", pii.listed(base).alias("s")).collect():
        assert r["s"] == _pii(r["text"]), (r["text"] or "")[:80]


def test_pii_accounts_context_and_redaction(spark):
    df = spark.createDataFrame([("iban GB82 WEST 1234 5698 7654 32.",), ("DE89370400440532013000 x",), ("DE89370400440532013001 x",), ("write to me@x.org now",), (None,)], "text string")
    found = rows_of(pii.redact(pii.detect(df)).select("text", pii.listed(F.col("pii")).alias("s"), F.col("pii")["score"].alias("score")))
    assert [r["s"] for r in found] == ["iban:5:32", "iban:0:22", "", "email:9:17", ""]
    assert [r["text"] for r in found] == ["iban <iban>.", "<iban> x", "DE89370400440532013001 x", "write to <email> now", ""]
    assert found[0]["score"] == [1.0] and found[1]["score"] == [0.8]


def test_pii_accounts_with_more_behind(spark):
    """Brute force: any start at a word's edge, any end at one, the country's length, and mod 97."""
    codes = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "DE89370400440532013001"]
    behind = ["", " BIC COBADEFF", " BIC COBADEFFXXX", " EUR 50", " 50", ". X", " x", "X", " DE89370400440532013000", "-7"]
    texts = [f"to {c}{b}" for c in codes for b in behind]

    def want(text):
        out, at = [], 0
        for m in re.finditer(r"\b[A-Z]{2}[0-9]{2}", text):
            for e in range(m.start() + 15, len(text) + 1):
                span = text[m.start() : e]
                code = span.replace(" ", "")
                if m.start() >= at and re.fullmatch(r"[A-Z0-9](?: ?[A-Z0-9])*", span) and not re.match("[A-Za-z0-9_]", text[e:]) and len(code) == {"DE": 22, "GB": 22, "NO": 15, "FR": 27, "MT": 31}.get(code[:2]):
                    if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                        out.append(f"iban:{m.start()}:{e}")
                        at = e
        return ",".join(out)

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    only = F.filter("pii", lambda x: x["kind"] == "iban")
    got = {r["text"]: r["s"] for r in pii.detect(df).select("text", pii.listed(only).alias("s")).collect()}
    assert got == {t: want(t) for t in texts} and got["to DE89370400440532013000 BIC COBADEFF"] == "iban:3:25"


@pytest.mark.parametrize(
    "text,score",
    [
        ("a trip on the ship 10.0.0.1", 0.5), ("ip 10.0.0.1", 0.7), ("10.0.0.1 is our server", 0.7), ("IP:10.0.0.1", 0.7), ("hostile 10.0.0.1 hosting", 0.5), ("version 10.0.0.1", 0.3), ("version 10.0.0.1 of the host", 0.5),
        ("the hotel +44 20 7946 0958", 0.6), ("tel +44 20 7946 0958", 0.8), ("+44 20 7946 0958 (mobile)", 0.8), ("discard 4111 1111 1111 1111", 0.7), ("card 4111 1111 1111 1111", 0.9), ("4111 1111 1111 1111 visas", 0.7),
        ("dis" + "card" + " " * 44 + "4111 1111 1111 1111", 0.7), ("x card" + " " * 44 + "4111 1111 1111 1111", 0.9), ("x card" + " " * 45 + "4111 1111 1111 1111", 0.7), ("card" + " " * 44 + "4111 1111 1111 1111", 0.9),
        ("4111 1111 1111 1111" + "." * 44 + "card", 0.9), ("4111 1111 1111 1111" + "." * 44 + "cards", 0.7), ("4111 1111 1111 1111" + "." * 43 + "cards.", 0.9),
    ],
)
def test_pii_context_words_are_whole(spark, text, score):
    got = pii.detect(spark.createDataFrame([(text,)], "text string")).select("pii.score").first()[0]
    assert [round(x, 2) for x in got] == [score]


def test_pii_of_very_many_spans_in_one_text(spark):
    """Time grows with the number of spans, not with its square, and neither positions nor contexts shift."""
    import time

    def spent(n):
        text = " ".join(f"{'email ' if i % 1000 == 0 else ''}a{i}@b.cc" + "ü漢😀"[i % 3] for i in range(n))
        began = time.time()
        found = pii.detect(spark.createDataFrame([(text,)], "text string")).first()["pii"]
        took = time.time() - began
        mails = [x for x in found if x["kind"] == "email"]
        assert [text[x["start"] : x["end"]] for x in mails] == [f"a{i}@b.cc" for i in range(n)]
        assert {i for i, x in enumerate(mails) if x["score"] > 0.95} >= set(range(0, n, 1000)) and sum(x["score"] > 0.95 for x in mails) <= n / 50 + 10
        return took

    spent(100)
    assert spent(50_000) < 3.5 * spent(20_000) + 2


def test_redaction_of_very_many_spans(spark):
    text = "".join(f"write to a{i}@b.cc. {'漢' * (i % 700)}" for i in range(300)) + "end"
    got = pii.redact(pii.detect(spark.createDataFrame([(text,), (None,), ("x",)], "text string"))).collect()
    assert [r["text"] for r in got] == [re.sub(r"a[0-9]+@b\.cc", "<email>", text), "", "x"]


# Web pages

_PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header class="site-header"><a href="/">Home</a> The site of the year</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
%s
<aside>The best of the rest of the web for you and your friends, all of it</aside><footer>&copy; 2020 the owners of the site and the others who are in it</footer></body></html>"""
_P1 = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness, and so on for all of us."
_P2 = "We had everything before us, we had nothing before us, and we were all going direct to the other way, as it is said to be in the books."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><h1>Tale &amp;amp; two</h1><p>{_P1}</p><p>Short.</p><p>{_P2}<div class='share-bar'>Share this with all of your friends</div></article>", ["Tale &amp; two", _P1, "Short.", _P2]),
        (f"<main><p>{_P1}<p>A&nbsp;&lt;b&gt; <i>x</i>y<br>z<form><input><label>The name of you</label></form></main>", [_P1, "A <b> xy z"]),
        (f"<div id=content><h2>Head</h2><p>{_P1}</p><p>Yes.</p><p>{_P2}</p></div><div class='comments'><p>{_P2} I think</p></div>", ["Head", _P1, "Yes.", _P2]),
        (f"<article><p>{_P1}</p><!-- <p>{_P2}</p> --><div class='ad'>{_P2}</div><section id='comments'><article><p>{_P2}</p></article></section></article>", [_P1]),
        (f"<div role='dialog' class='cookie-notice'>{_P2}</div><article><ul><li>one of</li><li>two</li></ul><p hidden>{_P2}</p><p>{_P1}", ["one of", "two", _P1]),
        ("", []),
    ],
)
def test_html(body, want):
    assert html_text.main_text(_PAGE % body) == "\n".join(want)


_FOREIGN = "Pewnego dnia stary rybak wypłynął daleko na morze i wrócił dopiero wieczorem, kiedy światła portu już dawno zgasły."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<div class='content-sidebar-wrap'><article><p>{_P1}</p></article></div>", [_P1]),
        (f"<div class='content-sidebar-wrap'><div id=content><p>{_P1}</p></div></div>", [_P1]),
        (f"<main class='has-sidebar'><p>{_P1}</p></main>", [_P1]),
        (f"<main class='sidebar'><p>{_P1}</p></main>", [_P1]),
        (f"<div class='content with-sidebar'><p>{_P1}</p></div>", [_P1]),
        (f"<article class='post category-legal'><p>{_P1}</p></article>", [_P1]),
        (f"<article class='post tag-popular'><p>{_P1}</p></article><article class='post popular'><p>{_P2}</p></article>", [_P1, _P2]),
        (f"<article class='post comments-open'><p>{_P1}</p></article>", [_P1]),
        (f"<article aria-label='Search engines explained'><p>{_P1}</p></article>", [_P1]),
        (f"<div class='sidebar-right'><article><p>{_P1}</p><p>{_P2}</p></article><div class='related'><article><p>{_P2}</p></article></div></div>", [_P1, _P2]),
        (f"<article><p>{_P1}</p></article><div class='related-posts'><article><p>{_P1}</p></article></div><div id='comments'><article class='comment'><p>{_P2}{_P2}</p></article></div>", [_P1]),
        (f"<article><p>{_P1}</p><div class='left-sidebar'>{_P2}</div><div class='site-footer'>{_P2}</div></article>", [_P1]),
    ],
)
def test_html_words_around_the_article(body, want):
    assert html_text.main_text(_PAGE % body) == "\n".join(want)


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Title</h1><p>Short.</p><ul><li><a>Report</a></li></ul></article>", ["Title", "Short.", "Report"]),
        (f"<article><h2><a href=#x>Results</a></h2><p>{_P1}</p><p><a>A paper on the results</a>, 2020</p></article>", ["Results", _P1, "A paper on the results, 2020"]),
        (f"<main><h2><a href=#x>Results</a></h2><p>{_P1}</p></main>", ["Results", _P1]),
        (f"<article><p>{_P1}</p><ul><li><a>One page</a><li><a>Another page</a><li><a>A third page</a></ul><p>Short.</p></article>", [_P1, "Short."]),
        (f"<article><p>{_FOREIGN}</p><p><a>Raport</a></p></article>", [_FOREIGN, "Raport"]),
        (f"<div><p>{_FOREIGN}</p><p>{_FOREIGN}</p></div>", [_FOREIGN, _FOREIGN]),
        (f"<div><h2><a href=#x>Morze</a></h2><p>{_FOREIGN}</p><p>Zobacz <a>port</a>, tam.</p><p>{_FOREIGN}</p></div>", ["Morze", _FOREIGN, "Zobacz port, tam.", _FOREIGN]),
        (f"<div><p>{_P1} {_P2}</p><p>So it was, <a>said he</a>.</p><p>{_P1} {_P2}</p></div>", [f"{_P1} {_P2}", "So it was, said he.", f"{_P1} {_P2}"]),
    ],
)
def test_html_links_and_languages(body, want):
    plain = "<body>%s</body>" if "<div>" in body else _PAGE
    assert html_text.main_text(plain % body) == "\n".join(want)


def _rules(blocks, doubtful):
    """The rules one block at a time, as their docstrings say, for blocks that are not among doubtful words or in ``doubtful`` regions."""
    inside = [b for b in blocks if not b.outside and (not b.doubt or b.region in doubtful)]
    words = [re.findall(r"[^\W\d_]+", b.text.lower()) for b in inside]
    share = lambda ws, listed: sum(w in listed for w in ws) / max(1, len(ws))
    plain = [w for b, ws in zip(inside, words) if b.region[0] == 0 and b.linked <= 0.2 * len(b.text) for w in ws]
    foreign = bool(plain) and all(share(plain, listed) < 0.15 for listed in html_text.LANGUAGES)
    label = []
    for b, ws in zip(inside, words):
        n, stop = len(b.text), share(ws, html_text.STOP_WORDS)
        if b.linked > 0.5 * n:
            label.append("short" if b.heading else "link" if b.region[0] else "bad")
        elif n < 70:
            label.append("short")
        elif b.region[0] or (foreign and b.linked <= 0.2 * n) or (stop >= 0.3 and n >= 200):
            label.append("good")
        else:
            label.append("near" if stop >= 0.15 else "bad")
    at = 0
    while at < len(label):
        end = at + 1
        if label[at] == "link":
            while end < len(label) and label[end] == "link" and inside[end].region == inside[at].region:
                end += 1
            many = end - at >= 3 and all(b.linked >= 0.9 * len(b.text) for b in inside[at:end])
            label[at:end] = ["bad" if many else "short"] * (end - at)
        at = end
    for kind in ("near", "short"):
        known = list(label)
        for i, b in enumerate(inside):
            if known[i] != kind:
                continue
            near = [next((known[k] for k in ks if known[k] in ("good", "bad") and inside[k].region == b.region), None) for ks in (range(i - 1, -1, -1), range(i + 1, len(known)))]
            if b.region[0]:
                good = near != ["bad", "bad"]
            elif kind == "near":
                good = "good" in near or near == [None, None]
            elif b.heading:
                good = near[1] == "good"
            else:
                good = "good" in near and "bad" not in near
            label[i] = "good" if good else "bad"
    held = Counter()
    for b, x in zip(inside, label):
        if x == "good":
            held[b.region[0]] += len(b.text)
    total = sum(held.values())
    # The surest kind of mark under which half of the good text stands, and whether what is surer still is small.
    kind = 2 if held[2] >= total / 2 else 1 if held[1] + held[2] >= total / 2 else 0
    small = {0: held[1] + held[2], 1: held[2], 2: total}[kind] < total / 4
    chosen = {id(b) for b, x in zip(inside, label) if x == "good" and (b.region[0] >= kind or b.within) and not (b.region[0] > kind and small)}
    return [id(b) in chosen for b in blocks]


def _rules_with_doubt(blocks):
    """Doubtful regions join from the least doubtful on, as the rules for each kind say."""
    joined, good = set(), _rules(blocks, set())
    groups = {}
    for b in blocks:
        if b.doubt and not b.outside:
            groups.setdefault((b.doubt, b.region), []).append(b)
    for doubt in sorted({d for d, _ in groups}):
        length = sum(len(b.text) for b, x in zip(blocks, good) if x)
        before = set(joined)
        for (d, region), mine in groups.items():
            if d != doubt:
                continue
            words = [re.findall(r"[^\W\d_]+", b.text.lower()) for b in mine]
            few = [w for b, ws in zip(mine, words) if b.linked <= 0.2 * len(b.text) for w in ws]
            foreign = bool(few) and all(sum(w in listed for w in few) / len(few) < 0.15 for listed in html_text.LANGUAGES)
            alone = []
            for b, ws in zip(mine, words):
                n, stop = len(b.text), sum(w in html_text.STOP_WORDS for w in ws) / max(1, len(ws))
                if b.linked <= 0.5 * n and n >= 70 and ((stop >= 0.3 and n >= 200) or (foreign and b.linked <= 0.2 * n)):
                    alone.append(n)
            if region[0]:
                joins = sum(len(b.text) for b in mine) > length and (doubt < html_text.READERS or length == 0)
            elif doubt < html_text.STRONG:
                joins = len(alone) >= 2 if mine[0].within else sum(alone) > 3 * length
            else:
                joins = doubt < html_text.READERS and length == 0 and len(alone) >= 3
            joined |= {region} if joins else set()
        if joined != before:
            good = _rules(blocks, joined)
    return good


def _random_block(rng, readers):
    words = rng.choice([["the", "of", "and", "house", "river"], ["xyzzy", "plugh", "frotz"], ["the", "xyzzy", "frotz", "plugh"]])
    text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 60])))
    region = rng.choice([(0, 0), (0, 0), (1, 1), (2, 2), (2, 3)])
    return html_text.Block(text, int(len(text) * rng.choice([0, 0, 0, 0.1, 0.3, 0.6, 1.0])), rng.random() < 0.2, region, rng.random() < 0.1, readers if rng.random() < 0.1 else 0)


def test_html_rules_by_brute_force():
    rng = random.Random(11)
    for trial in range(1500):
        allowed = [(0, 0), (1, 1)] if trial % 3 == 0 else [(0, 0)] if trial % 3 == 1 else [(0, 0), (1, 1), (2, 2), (2, 3)]
        found = [b for b in (_random_block(rng, 0) for _ in range(rng.randint(0, 14))) if b.region in allowed]
        html_text.classify(found)
        assert [b.label == "good" for b in found] == _rules(found, set())


def test_html_doubt_by_brute_force():
    rng, won = random.Random(12), Counter()
    for trial in range(1500):
        found = [_random_block(rng, 0) for _ in range(rng.randint(0, 6))] if trial % 3 else []
        for region in [(0, 11), (0, 12), (0, 13), (2, 14)][: rng.randint(1, 4)]:
            doubt, within = rng.choice([1, 2, 10, 11, html_text.READERS]), region[0] == 0 and rng.random() < 0.3
            for _ in range(rng.randint(1, 5)):
                b = _random_block(rng, 0)
                b.region, b.doubt, b.within = region, doubt, within
                found.append(b)
        html_text.classify(found)
        assert [b.label == "good" for b in found] == _rules_with_doubt(found)
        won.update((b.doubt, b.region[0], b.within) for b in found if b.label == "good")
    assert {(0, 0, False), (1, 0, False), (1, 0, True), (1, 2, False)} <= set(won) and won[html_text.READERS, 0, False] == 0


_SIX = [f"{_P1} {_P2} That is what part {i} of the story tells us." for i in range(6)]
_CARD = "<h3>Another story</h3><p>It is the story of the man who was in the house of the others and who was not there.</p>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div id=x>%s</div><article>{_CARD}</article>", f"<div id=x>%s</div><div class='entry'>{_CARD}</div>", f"<main>%s</main><div><article>{_CARD}</article></div>",
        "<div class='widget-text'>%s</div>", "<div class='social-history'>%s</div>", "<div class='popular-science'>%s</div>", "<section id='search-for-truth'>%s</section>",
        "<form id=all><div>%s</div><div class='search-box'><input></div></form>", f"<form><article>%s</article><div class='related-posts'>{_CARD}</div></form>", "<aside>%s</aside>",
        f"<article>%s<div class='newsletter-signup'>{_CARD * 9}</div></article>", f"<div>%s</div><div class='sidebar'><p>{_P1} {_P2}</p></div>",
    ],
)
def test_html_the_passes_outweigh_marks(body):
    comments = f"<div id='comments'><div class='comment-body'>{f'<p>{_P2} {_P1} I think</p>' * 9}</div></div>"
    page = _PAGE % (body % "".join(f"<p>{p}</p>" for p in _SIX) + comments)
    assert html_text.main_text(page) == "\n".join(_SIX)


def test_html_subjects_within_an_article():
    other = [f"{p} Of science." for p in _SIX[:3]]
    page = f"<article>{''.join(f'<p>{p}</p>' for p in _SIX)}<div class='popular-science'>{''.join(f'<p>{p}</p>' for p in other)}</div></article>"
    assert html_text.main_text(page) == "\n".join(_SIX + other)


@pytest.mark.parametrize("name, doubt", [("ad", 10), ("ad-300x250", 10), ("c-promo__title", 10), ("cookie-policy-banner", 10), ("popular-science", 1), ("comment-body", 1_000_000), ("responses-to-critics", 1), ("story", 0), ("with-sidebar", 0)])
def test_html_how_plain_a_name_is(name, doubt):
    assert html_text._marked(name, False) == doubt


def test_html_rules_decide():
    """What stands next to a block decides, not only where it stands."""
    links = "".join(f"<li><a href=/{i}>Another page {i}</a></li>" for i in range(4))
    page = f"<article><p>{_P1}</p><p>Short.</p><p>{_P2}</p><ul>{links}</ul><p>More to read</p><ul>{links}</ul></article>"
    assert html_text.main_text(page) == "\n".join([_P1, "Short.", _P2])
    # Without any mark: stop words, links and neighbours alone.
    page = f"<div>{links}</div><div><h2>Head</h2><p>{_P1} {_P2}</p><p>Short.</p><p>{_P1} {_P2}</p></div><div>{links}<p>End</p></div>"
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join(["Head", f"{_P1} {_P2}", "Short.", f"{_P1} {_P2}"])
    # An element marked as an article in which only links stand is none.
    page = f"<article><ul>{links}</ul></article><div><p>{_P1} {_P2}</p></div>"
    assert html_text.main_text(page) == f"{_P1} {_P2}"


@pytest.mark.parametrize(
    "opening", ["<main class='content has-sidebar'>", "<div class='layout no-sidebar'>", "<div class='page-with-nav'>", "<article class='post category-popular'>", "<article class='post comments-closed'>", "<article class='post related-none'>"]
)
def test_html_words_of_state(opening):
    assert html_text.main_text(_PAGE % f"{opening}<p>{_P1} {_P2}</p><p>{_P2} {_P1}</p>") == f"{_P1} {_P2}\n{_P2} {_P1}"


@pytest.mark.parametrize("page", ["<a" * 200_000, "<div>ok now</div>" * 25_000, "<b>" * 60_000 + "</i>" * 60_000, '<a x=">\'' * 50_000, "<b>" + "<div>" * 40_000 + "</b>" * 40_000, "<div class=ad>ok now" * 20_000, "<svg/>" * 60_000])
def test_html_of_any_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_html_tags_that_do_not_end():
    assert [b.text for b in html_text.blocks_of("<p>a <b x='>'>b</b> <i y=\"1>c</i> d")] == ["a b c d"]
    assert [b.text for b in html_text.blocks_of("<p>a < b <c")] == ["a < b <c"]
    assert [b.text for b in html_text.blocks_of("<p>x<!-- a > b --><![CDATA[ <p> ]]><?pi?>y<!doctype html>z")] == ["xyz"]


def test_html_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>a < b", "x"), (4, "<" * 5000 + "<p" * 3000, "x"), (5, "<div>" * 5000 + "x", "x")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == "" and set(got) == {1, 2, 3, 4, 5}


def test_html_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html

    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", p)).replace("<b>", "").replace("</b>", "").split()) for p in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


# Near duplicates


def _fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, odd):
    base = docs.where("length(text) BETWEEN 200 AND 2000").orderBy("doc_id").limit(20).collect()
    rng, near = random.Random(1), []
    for k, r in enumerate(base):
        words = r["text"].split()
        for m in range(6):
            words = words.copy()
            words[rng.randrange(len(words))] = f"w{m}"
            near.append((400_000 + 10 * k + m, " ".join(words)))
    df = docs.where("doc_id <> 100011 AND doc_id <> 100012").select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")).withColumn("fp", F.lit("x"))
    fps = {r["doc_id"]: _fingerprint(r["text"]) for r in df.collect()}
    ids = sorted(fps)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = _reach(ids, linked)
    got = {r["doc_id"]: (r["f"], r["component_id"]) for r in simhash.near_groups(df).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert any(want[i] != i and fps[want[i]] != fps[i] for i in ids)  # not copies alone


@pytest.mark.parametrize("cell,distance", [(2, 2), (1024, 2), (3, 3), (8, 1)])
def test_links_of_dense_fingerprints(spark, monkeypatch, cell, distance):
    """Also with nodes that overflow a task, which are dealt out in blocks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "TASK_ROWS", 64)
    rng = random.Random(cell)
    values = {0, (1 << 64) - 1}
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            v = centre
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    v = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in v] * 2, "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(v) for b in v[i + 1 :] if (a ^ b).bit_count() <= distance}
    assert {(r["a"], r["b"]) for r in simhash.links(df, distance).collect()} == want
    few = {(r["a"], r["b"]) for r in simhash.links(df, distance, False).collect()}
    assert few <= {tuple(sorted((a, b))) for a, b in few} and _reach(map(signed, v), few) == _reach(map(signed, v), want)


def test_components(spark):
    rng = random.Random(2)
    chain = list(range(60))
    for edges in ([], list(zip(chain, chain[1:])), [(0, i) for i in range(1, 40)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(5, 5)]):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == _reach({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])


def _vectors(seed=0, n=300):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    copies = base[:60] + rng.normal(size=(60, 16)) * rng.choice([0.02, 0.2, 0.5], size=(60, 1))
    x = np.concatenate([base, copies, base[:20], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.05]).astype("float32")
    return [(i, v.tolist(), int(i % 3) if i < n else int((i - n) % 60 % 3)) for i, v in enumerate(x)]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = _vectors()
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float("inf")] * 16, 1), (1005, [1.0] * 3, 1), (1006, rows[0][1], None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    x, lab = np.array([v for _, v, _ in rows], dtype=float), np.array([c for *_, c in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    want = _reach(range(len(x)), zip(*np.nonzero(near)))
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.97 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i]["component_id"] != want[i] for i in range(len(x))) <= 0.02 * len(x)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, *_ in odd)


def _links(rows):
    """Brute force ``(n_links, component_id)`` by id, for usable vectors of any length."""
    want = {}
    for dim, label in {(len(v), c) for _, v, c in rows}:
        ids = np.array([i for i, v, c in rows if (len(v), c) == (dim, label)])
        x = np.array([v for _, v, c in rows if (len(v), c) == (dim, label)], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        root = _reach(ids.tolist(), ((ids[a], ids[b]) for a, b in zip(*np.nonzero(near))))
        want.update({i: (int(n), int(root[i])) for i, n in zip(ids.tolist(), near.sum(1))})
    return want


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Also with a stray length, whichever vector comes first, and numbers."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rows = _vectors()
    rows += [(2000 + i, v[:12], c) for i, v, c in rows[::2]]
    rows += [(3000 + i, [1.0, 0.01 * i, 2.0], 1) for i in range(9)] + [(4000 + i, [float(x)], 1) for i, x in enumerate((3, 5, -2, 5, -1))]
    rows += [(5000 + k, [1.0] * (20 + k), 1) for k in range(60)]
    want = _links(rows)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == want[i] for i in want if i >= 3000)
    for low, high in ((0, 2000), (2000, 3000)):
        ids = [i for i in want if low <= i < high]
        assert sum(got[i]["n_links"] for i in ids) >= 0.97 * sum(want[i][0] for i in ids) > 0
        assert sum(got[i]["component_id"] != want[i][1] for i in ids) <= 0.02 * len(ids)


@pytest.mark.parametrize("margin", [0.0, 0.05])
def test_links_count_for_both_ends(spark, monkeypatch, margin):
    """Also where only one end meets the other: the ends' counts add up to pairs, and no row that links with one says 0."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    fit = embedding_dedup.MultiIndex.__init__

    def narrow(self, *args):
        fit(self, *args)
        self.margin = margin

    monkeypatch.setattr(embedding_dedup.MultiIndex, "__init__", narrow)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 6))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in got) % 2 == 0
    sizes = Counter(r["component_id"] for r in got)
    assert all((sizes[r["component_id"]] > 1) == (r["n_links"] > 0) for r in got)


def test_vectors_recall_of_links(spark, sf_dir, monkeypatch):
    """The production recall against brute force, with cells even where the table is small."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in e.collect()]
    want = _links([(i, v, c) for i, v, c in rows if c is not None and v and any(v) and np.isfinite(v).all()])
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(e).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got[i] for i in want) >= 0.99 * sum(n for n, _ in want.values())


def test_vectors_with_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, b, 0), (3, a, 1), (None, a, 0), (None, [0.0, 0.0, 1.0], 0), (None, [0.0, 0.01, 1.0], 0), (4, a, 1), (4, a, 1), (5, None, 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (4, 2, 3, False), (4, 2, 3, False), (5, 0, 5, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_vectors_recall_at_size(spark):
    """50,000 vectors of 64 components, half of them copies at cosines around and above the threshold."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(25_000, 64)) + 2 * rng.normal(size=(40, 64))[rng.integers(0, 40, 25_000)]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.978, 0.999, size=(len(base), 1))
    x = np.concatenate([base, cos * base + (1 - cos**2) ** 0.5 * noise])
    labels = np.arange(len(x)) % 25_000 % 5
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    got = np.zeros(len(x), dtype=int)
    for r in embedding_dedup.near_vectors(df.repartition(8)).collect():
        got[r["vec_id"]] = r["n_links"]
    want = np.zeros(len(x), dtype=int)
    for c in range(5):
        at = np.flatnonzero(labels == c)
        want[at] = (x[at] @ x[at].T >= 0.98).sum(1) - 1
    print(f"recall of links {got.sum() / want.sum():.5f}")
    assert (got <= want + 1).all() and got.sum() >= 0.99 * want.sum() > 0


def test_multi_sequence_order():
    index = embedding_dedup.MultiIndex(np.random.default_rng(0).normal(size=(500, 8)), 5000, 0.98, 0.99)
    x = np.random.default_rng(1).normal(size=(20, 8))
    d1, d2 = index.distances(x)
    for k, cells in enumerate(index.visited(x)):
        sums = d1[k][:, None] + d2[k]
        within = sums <= sums.min() + index.margin
        assert len(cells) == len(set(cells)) == within.sum()
        order = [sums[c] for c in cells]
        assert order == sorted(order)


def test_vectors_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert embedding_dedup.near_vectors(e).count() == e.count()


# Mixing


def _targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / free for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing(docs):
    got = rows_of(mixing.plan(docs.withColumn("size", F.lit(1)).withColumn("target", F.lit(1)), shards=7))
    words = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    want = _targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] == words[r["row_id"]] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert len(r["shards"]) <= 3 and all(0 <= s < 7 for s in r["shards"])
        taken[r["source"]] += r["size"] * len(r["shards"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(words)
    for s, t in want.items():
        assert t - largest[s] <= taken[s] <= t + 1e-6
    again = {r["row_id"]: r["shards"] for r in rows_of(mixing.plan(docs.repartition(7), shards=7))}
    assert again == {r["row_id"]: r["shards"] for r in got}


def test_splitting_tree_of_groups(spark, monkeypatch):
    """More sources than a row holds: exact, disjoint and balanced all the same."""
    monkeypatch.setattr(mixing, "GROUP", 8)
    rng = random.Random(0)
    quotas = {f"s{i}": rng.choice([0, 1, 5, 40]) for i in range(60)} | {None: 7}
    for shards in (5, 8):
        rows = rows_of(mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long"), shards))
        per = Counter()
        for s, n in quotas.items():
            mine = sorted((r["start"], r["quota"]) for r in rows if r["source"] == s and r["quota"])
            assert sum(q for _, q in mine) == n and all(a + q == b for (a, q), (b, _) in zip(mine, mine[1:]))
        for r in rows:
            per[r["shard"]] += r["quota"]
        assert sorted(per) == list(range(shards)) and max(per.values()) - min(per.values()) <= shards


def test_splitting_tree(spark):
    quota = spark.createDataFrame([("a", 1000), ("b", 37), (None, 0), ("c", 1)], "source string, quota long")
    for shards in (1, 2, 5, 8):
        rows = rows_of(mixing.split_quotas(quota, shards))
        per = Counter()
        for s, n in (("a", 1000), ("b", 37), (None, 0), ("c", 1)):
            mine = sorted((r["start"], r["quota"]) for r in rows if r["source"] == s and r["quota"])
            assert sum(q for _, q in mine) == n and all(a + q == b for (a, q), (b, _) in zip(mine, mine[1:]))
        for r in rows:
            per[r["shard"]] += r["quota"]
        assert sorted(per) == list(range(shards)) and max(per.values()) - min(per.values()) <= shards


def test_hypergeometric(spark):
    """Shares of a thousand draws come near the exact ones."""
    from math import comb

    good, total, drawn = 5, 30, 12
    df = spark.range(4000).select(mixing._hypergeometric(F.lit(good), F.lit(total), F.lit(drawn), (F.col("id") + 0.5) / 4000).alias("x"))
    got = {r["x"]: r["count"] / 4000 for r in df.groupBy("x").count().collect()}
    for x in range(good + 1):
        assert abs(got.get(x, 0) - comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)) < 0.002


def test_mixed_rows(docs):
    planned = mixing.plan(docs, shards=3)
    want = {r["row_id"]: len(r["shards"]) for r in planned.collect() if r["shards"]}
    clash = docs.withColumn("turn", F.lit("x")).withColumn("shard", F.lit("x")).withColumn("key", F.lit("x")).withColumn("block", F.lit("x"))
    got = mixing.mix(clash, shards=3)
    assert Counter(r["doc_id"] for r in got.collect()) == want and set(got.columns) == set(clash.columns)
    assert {(r["row_id"], s) for r in planned.collect() for s in r["shards"]} == {(r["doc_id"], r["shard"]) for r in got.collect()}


def test_mixing_many_sources_and_repeated_rows(spark):
    """More sources than a list of results holds; rows that repeat an id go together."""
    rows = [(i // 2 if i % 10 == 0 else i, "w " * (i % 7), f"s{i % 90:03d}" if i % 90 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.plan(df, shards=4))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = _targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["size"] * len(r["shards"])
    assert len(got) == 900 and all(t - 14 <= taken[s] <= t + 1e-6 for s, t in want.items())


# Languages


def test_language_id(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(~queries.held_out()))
    held = langid.predict(docs.where(queries.held_out()), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    got = {r["doc_id"]: r for r in langid.predict(odd.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), model).collect()}
    for i, t in enumerate(TEXTS):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] != "und") == letters and 0 <= got[i]["score"] <= 1
    assert set(model.langs) == {"en", "de", "fr", "es"}


def test_language_backoff():
    at = {"en": np.array([1.0, -1.0]), "de": np.array([-1.0, 1.0])}
    model = langid.Model(["de", "en"], {"the": at["de"][::-1] * -1}, {2: {"sc": at["en"]}, 1: {"q": at["de"]}})
    assert model.word("sch")[0] == langid.BACKOFF**3 and model.word("q")[1] == langid.BACKOFF**4 and not model.word("漢").any()


@pytest.mark.parametrize("rows", [[(1, None, "en"), (2, "", "en")], [(1, "hello the world", "en"), (2, "123", "fr")], [(None, "a a a", "en"), (None, "\u00bd \u00b2 \u2167", None), (3, "b b b", "de")]])
def test_language_of_texts_without_letters(spark, rows):
    """Batches in which a language has no letters teach nothing and break nothing; numerals are no letters."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.select("doc_id", queries.held_out().alias("held_out"), "text"), langid.fit(docs)).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        learned = any(lang and any(c.isalpha() for c in t or "") for _, t, lang in rows)
        assert (r["lang_pred"] != "und") == (learned and any(c.isalpha() for c in r["text"] or ""))


def test_language_sample_is_never_empty_by_rounding(spark):
    assert int(20_000 / 1e15 * langid.HASHES) > 1_000_000


def test_language_scores_by_brute_force(spark, docs):
    """The rules word by word, without the tables that the workers keep."""
    model = langid.fit(docs.where("doc_id % 3 <> 0"))
    odd = "Uncommonly stränge wörds für \u6f22\u5b57 ½ x\u00b2y Zzzzzq"

    words_known = dict(zip(model.words, model.table))
    grams = {n: dict(zip(*of)) for n, of in model.grams.items()}

    def score(word):
        if word in words_known:
            return words_known[word]
        for k, n in enumerate(langid.GRAMS):
            marked = f"<{word}>"
            known = [grams[n][g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in grams.get(n, {})]
            if known:
                return np.mean(known, axis=0) * langid.BACKOFF**k
        return np.zeros(len(model.langs))

    for text in [odd, *(r["text"] for r in docs.limit(60).collect())]:
        words, word = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words, word = [*words, word], ""
        got = model.predict(text)
        if not words:
            assert got == ("und", 0.0)
            continue
        mean = np.mean([score(w) for w in words], axis=0)
        share = np.exp((mean - mean.max()) * min(len(words), 20))
        assert got[0] == model.langs[int(np.argmax(mean))] and got[1] == pytest.approx(share.max() / share.sum())


# Packing


def test_tokens_match_the_library(docs):
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(queries.vocabulary()), tokens.WordIds(queries.vocabulary())
    texts = [r["text"] or "" for r in docs.collect()] + ["<|endoftext|>x <|startoftext|>", "don't I'LL 've ' s", "ﬁ Å Ａ İı Σας ſ ǅ", "a b c\x85d\x1ce", "é ́x", "12345 ½²", "Œœ ÿß × ÷"]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(words.text_ids(t), dtype="<u4").tolist() == e.ids, t[:50]


def test_tokens_of_another_vocabulary(docs, tmp_path):
    """A file with other rules is not taken apart into words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    stated = json.load(open(queries.vocabulary(), encoding="utf-8"))
    stated["normalizer"]["normalizers"].pop()  # case matters
    (tmp_path / "other.json").write_text(json.dumps(stated), encoding="utf-8")
    texts = [r["text"] or "" for r in docs.limit(40).collect()] + ["Don't  STOP now", "a\n b"]
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "other.json")):
        tok, words = Tokenizer.from_file(path), tokens.WordIds(path)
        assert not words.wordwise
        for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(words.text_ids(t), dtype="<u4").tolist() == e.ids
    assert tokens.WordIds(queries.vocabulary()).wordwise


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    rows = docs.collect()
    ids = {r["doc_id"]: [*e.ids, 1] for r, e in zip(rows, tok.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    got = rows_of(packing.pack_documents(docs.withColumn("length", F.lit(1)), queries.vocabulary(), capacity=capacity))
    by = defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == sum(-(-len(x) // capacity) for x in ids.values())
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(map(len, ids.values()))
    assert len(by) <= 1.03 * -(-total // capacity) + 1


def _least(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plan_is_near_the_optimum():
    rng, worse = random.Random(1), 0
    for _ in range(800):
        capacity = rng.choice([10, 12, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        plan, best = packing.Plan(Counter(items), capacity), _least(items, capacity)
        assert best <= plan.sequences <= best + 1
        worse += plan.sequences > best
    assert worse <= 8


def test_repeated_documents_are_packed_twice(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    got = packing.pack_documents(df, queries.vocabulary(), capacity=8).collect()
    assert len(got) == 5 and len({(r["sequence_id"], r["offset"]) for r in got}) == 5


# Archives


def _pages(spark):
    body = "<p>" + "x" * 200
    rows = [(5, "http://a/5", body), (2, "http://a/2", body), (9, "http://a/9", body), (1, None, "short"), (7, "http://a/7", "short"), (3, "", None), (4, "http://a/ä\nb", ""), (6, "u", "é" * 49), (8, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", "z\r\n\r\nWARC/1.1\r\n" * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x"))


def test_warc(spark, tmp_path):
    pages = _pages(spark)
    want, first = {}, {}
    for r in sorted(pages.collect(), key=lambda r: r["page_id"]):
        p = (r["html"] or "").encode()
        to = first.setdefault(p, r["page_id"]) if len(p) >= 100 else r["page_id"]
        revisit = to != r["page_id"]
        want[r["page_id"]] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None, None if revisit else p.decode())
    address = {r["page_id"]: r["url"] for r in pages.collect()}
    manifests = []
    for k, df in enumerate((pages, pages.repartition(5).orderBy(F.desc("page_id")))):
        uri = f"file://{tmp_path}/{k}"
        done = warc.write(df, uri, shard_bytes=300, roll_bytes=500)
        manifests.append(sorted((r.asDict() for r in warc.files(spark, uri).collect()), key=lambda r: r["name"]))
        assert done["files"] == len(manifests[-1]) and done["records"] == len(want) and done["shards"] > 2 and json.loads((tmp_path / f"{k}" / "manifest.json").read_text()) == done
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in warc.read(spark, uri).collect()}
        assert got == want and {r["page_id"]: r["url"] for r in warc.read(spark, uri).collect()} == address
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3  # the same bytes however rows are dealt
    for f in manifests[0]:
        assert hashlib.sha256((tmp_path / "0" / f["name"]).read_bytes()).hexdigest() == f["sha256"]
    assert not (tmp_path / "0" / "_temporary").exists()
    (tmp_path / "0" / "_manifests" / sorted(p.name for p in (tmp_path / "0" / "_manifests").glob("*.json"))[0]).unlink()
    with pytest.raises(ValueError):
        warc.files(spark, f"file://{tmp_path}/0")


@pytest.mark.parametrize("shard_bytes", [150, 1 << 20])
def test_warc_null_and_repeated_ids(spark, tmp_path, shard_bytes):
    """Rows are judged by their own payload, wherever shards are cut."""
    a, b = "a" * 120, "b" * 130
    rows = [(1, "u1", a), (2, "u2", a), (2, "u3", b), (2, "u3", b), (3, None, b), (None, "u4", a), (None, "u5", b), (None, "u5", b), (4, "", "x"), (4, " ", None)] + [(None, f"n{i}", f"{i}" * 100) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    warc.write(df, f"file://{tmp_path}/x", shard_bytes=shard_bytes)
    got = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read(spark, f"file://{tmp_path}/x").collect())
    first = {a: 1, b: 2}
    want = Counter()
    for i, u, h in rows:
        to = first.get(h) if i is not None and first.get(h) != i else None
        want[i, u, "revisit" if to else "response", to, hashlib.sha256((h or "").encode()).hexdigest()] += 1
    assert got == want
    ids = [line for p in tmp_path.glob("x/*.gz") for line in __import__("gzip").decompress(p.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)


def test_warc_shards_are_cut_by_bytes(spark):
    """Shards hold about equal bytes, also where one id has most of them."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i, f"{rng.getrandbits(256):064x}", rng.choice([10, 10, 5000])) for i in range(3000)]
    known = spark.createDataFrame(rows, "page long, digest string, size long")
    cuts = warc.boundaries(known, 100_000)
    p = np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], dtype=np.int64)
    d = np.array([int(r[1][:15], 16) for r in rows])
    held = Counter()
    for at, r in zip(warc.shard_numbers(p, d, cuts), rows):
        held[at] += r[2]
    assert len(held) == len(cuts) + 1 == -(-sum(r[2] for r in rows) // 100_000) and max(held.values()) <= 105_000
    assert [int(x) for x in warc.shard_numbers(p, d, cuts)] == [sum(c <= (a, b) for c in cuts) for a, b in zip(p.tolist(), d.tolist())]


def test_warc_damage_is_noticed():
    data = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse(data)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))


def test_a_shard_that_is_written_again_takes_over_its_files(tmp_path, monkeypatch):
    """Also on stores that do not move onto a name that exists; a file of other bytes is replaced."""
    data = [warc.record(i, "u", f"{i}".encode() * 300, hashlib.sha256(f"{i}".encode() * 300).hexdigest(), None) for i in range(6)]

    class Strict:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            assert not (tmp_path / b).exists()
            self.fs.move(a, b)

    found = warc._fs
    monkeypatch.setattr(warc, "_fs", lambda uri: (Strict(found(uri)[0]), found(uri)[1]))
    for folder in ("_temporary", "_manifests"):
        (tmp_path / folder).mkdir()

    def run(records, commit=True):
        shard = warc._Shard(f"file://{tmp_path}", 3, 150)
        for d in records:
            shard.add(d)
        return shard.commit() if commit else None

    run(data[:4], commit=False)  # lost after some files were moved
    left = sorted(tmp_path.glob("*.gz"))
    assert left
    left[0].write_bytes(b"broken")
    files = run(data)
    held = {f["name"]: f["sha256"] for f in files}
    assert {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.gz")} == held
    assert run(data) == files and not any((tmp_path / "_temporary").iterdir())
    assert [json.loads(line)["name"] for line in (tmp_path / "_manifests" / "shard-000003.json").read_text().splitlines()] == [f["name"] for f in files]


def test_very_large_and_small_components_link(spark):
    rows = [(i, [x * s for x in (3.0, 4.0, 1.0)], 0) for i, s in enumerate((1.0, 1e300, 1e-300, 1e154, 5e-324))] + [(9, [-1e300, 1e300, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: got[i] for i in range(5)} == {i: (4, 0) for i in range(5)} and got[9] == (0, 9)


def test_the_codebooks_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Wide vectors are sampled by fewer rows; links are still found."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_BYTES", 8 * 48 * 60)
    sizes, fit = [], embedding_dedup.MultiIndex.__init__

    def seen(self, sample, *args):
        sizes.append(len(sample))
        fit(self, sample, *args)

    monkeypatch.setattr(embedding_dedup.MultiIndex, "__init__", seen)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 48))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert len(sizes) == 1 and 20 < sizes[0] < 120
    assert sum(n > 0 for n in got.values()) >= 0.99 * 400


def test_many_languages_keep_all_their_entries(spark):
    """No language is left out and none keeps fewer entries for there being many."""
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzabcdefghij"]
    docs = spark.createDataFrame([(i, " ".join(f"{x}{c}{x}{x}" for c in "klm") + " " + " ".join([x * 4] * 5), f"l{x}") for i, x in enumerate(names)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == sorted(f"l{x}" for x in names) and {x * 4 for x in names} <= set(model.words)
    few = langid.fit(docs.where("doc_id < 5"))
    grams = lambda m, x: {g for known, _ in m.grams.values() for g in known if x in g}
    assert grams(few, "aukau") and grams(few, "aukau") <= grams(model, "aukau")
    assert [r["lang_pred"] for r in langid.predict(docs, model).orderBy("doc_id").collect()] == [f"l{x}" for x in names]
