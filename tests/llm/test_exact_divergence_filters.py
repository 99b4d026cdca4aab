"""Exact copies, source divergence and filter interactions against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from flightloom.llm import divergence, exact_dedup, interactions

SCHEMA = "doc_id long, text string, lang string, source string, id long, body string, h string, n long, kept boolean, keep_id long, part string, bits int, terms string, row string, total long"
EXTRA = (7, "x", "x", 7, False, 7, "x", 7, "x", "x", 7)
LONG = "Word " * 300_000


def rows(seed=0):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "déjà", "Éa", "x1y", "日本", "$5", "a|b", "the", "_"]
    text = lambda k: " ".join(rng.choices(words, weights=range(1, 12), k=k))
    out = [(i, text(rng.choice([1, 3, 40, 230])), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, "é"])) for i in range(150)]
    same = text(220)
    out += [(200 + i, same, "en", "s0") for i in range(60)] + [(300, same.upper(), "en", "s1"), (301, same.lower(), "de", "s1")]
    out += [(400, None, None, None), (401, "", "en", None), (402, " \t\r\n", "fr", "s9"), (403, LONG, "en", "s1"), (404, LONG.lower(), "en", "s1")]
    out += [(405, same, "en", "s0"), (405, same, "en", "s0"), (None, same, "en", "s0"), (None, "only here", "en", "s0"), (None, "only here", "xx", "s0"), (406, "É é", "xx", "s1"), (407, "é é", "xx", "s1"), (408, "a\x00b A", "xx", "\x00")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in rows()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def weak(text):
    return F.pmod(F.length(text), F.lit(3))


@pytest.mark.parametrize("digest", [exact_dedup.hash128, weak])
def test_exact_copies(docs, digest):
    groups = defaultdict(list)
    for i, t, _, _ in rows():
        groups[fold(t)].append(i)
    want = Counter()
    for i, t, _, _ in rows():
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()] += 1
    got = exact_dedup.mark_copies(docs, digest=digest)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_exact_copies_dropped(docs, empty):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    marked = exact_dedup.mark_copies(docs).where("kept")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.id for r in marked.collect())
    assert exact_dedup.mark_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def terms_of(text):
    out, word = [], ""
    for c in fold(text) + " ":
        if "a" <= c <= "z" or ord(c) >= 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def audited(data, least, k):
    found, in_lang, have = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in data:
        lang, words = lang or "", terms_of(t)
        found[lang, source or ""].update(words)
        in_lang[lang].update(words)
        have[lang].update(set(words))
    out = []
    for lang in in_lang:
        kept = [t for t, n in have[lang].items() if n >= least]

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, sources = share(in_lang[lang]), [s for la, s in found if la == lang]
        p = {s: share(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, k)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
                out += [(lang, s, a, item, value, n + 1) for n, (a, item, value) in enumerate(ranked)]
    return Counter(out)


@pytest.mark.parametrize(("least", "k", "block", "postings"), [(30, 50, 128, 20_000), (1, 3, 2, 5), (10_000, 50, 128, 20_000)])
def test_divergence(docs, monkeypatch, least, k, block, postings):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    got = divergence.audit(docs, least, k)
    want = audited(rows(), least, k)
    assert Counter(tuple(r) for r in got.collect()) == want and want


def test_divergence_many_terms(spark):
    """Ties, many buckets, dictionaries that are sent on before a task ends."""
    rng = random.Random(3)
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    data = [(i, " ".join(name(int(rng.paretovariate(0.7)) % 3000) for _ in range(rng.randint(1, 400))), rng.choice(["en", "de"]), f"s{min(rng.randint(0, 30), 9)}") for i in range(300)]
    frame = spark.createDataFrame([r + EXTRA for r in data], SCHEMA)
    for least, k in ((1, 50), (3, 7)):
        assert Counter(tuple(r) for r in divergence.audit(frame, least, k).collect()) == audited(data, least, k)


def test_divergence_empty_and_large_counts(spark, empty):
    assert divergence.audit(empty).count() == 0
    big = spark.range(1).select(divergence._share(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**9).cast("long")).alias("p")).first().p
    assert big == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**9)


def test_dictionaries_are_bounded():
    import pyarrow as pa

    texts = [" ".join(f"w{chr(97 + i % 26)}{'b' * (j % 50)}{'c' * (j // 50)}" for j in range(1500)).encode() for i in range(400)]
    batch = pa.record_batch([pa.array(["en"] * 400), pa.array(["s"] * 400), pa.array(texts, pa.binary())], names=["lang", "source", "text"])
    total, sent = Counter(), 0
    for out in divergence._counted([batch]):
        sent += 1
        for t, n in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True):
            total[t] += n
    want = Counter()
    for t in texts:
        want.update(t.split())
    assert total == want and sent >= 1


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 0, 1), (4, None, None), (205, 1, 1), (405, 1, 0), (403, 1, 1), (9999, 1, 1), (None, 1, 1), *[(i, i % 2, i % 3 == 0) for i in range(210, 260)]]


def fails(data):
    first = {}
    for i, t, _, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang, _ in data:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        marks = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i]
        out.append((i, lang or "", {f for f, m in zip("ABCDE", marks, strict=True) if m}))
    return out


def test_filter_interactions(spark, docs):
    labels = spark.createDataFrame([(a, b, None if c is None else int(c), "x", 7) for a, b, c in LABELS], "doc_id long, quality int, toxic int, part string, id long")
    good, toxic = ({i for i, *x in LABELS if x[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, part, bad in fails(rows()):
        parts[part].append((i, bad))
    want, shapley = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in members if f in x[1]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), step + 1] = (len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in members), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
    got = interactions.interactions(docs, labels).collect()
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        assert tuple(r)[3:9] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_bitmaps_of_many_parts_and_batches():
    import pyarrow as pa

    rng = random.Random(1)
    data = [(f"p{rng.randint(0, 40)}", rng.randint(0, 127)) for _ in range(3000)]
    cut = [pa.record_batch([pa.array([x[0] for x in data[a : a + 700]]), pa.array([x[1] for x in data[a : a + 700]], pa.int32())], names=["part", "bits"]) for a in range(0, 3000, 700)]
    got = {}
    for b in interactions._counted([*cut, cut[0].slice(0, 0)]):
        for r in b.to_pylist():
            got[r["part"], r["before"], r["filter"]] = tuple(r.values())[3:]
    for (part, before, f), values in got.items():
        mine = [b for p, b in data if p == part]
        there = [b for b in mine if not b & before]
        gone = [b for b in there if b >> f & 1]
        assert values == (len(there), len(gone), sum(b >> 5 & 1 for b in gone), sum(b >> 6 & 1 for b in gone), sum(b >> f & 1 for b in mine), sum(b & 31 == 1 << f for b in mine))
    assert len(got) == 41 * 80


def test_filters_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.interactions(empty, none).count() == 0
    got = interactions.interactions(docs, none)
    assert got.where("good_lost > 0 or toxic_lost > 0").count() == 0 and got.count() > 0
