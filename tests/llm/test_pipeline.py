"""The pipeline's stages on a small table: decisions take effect, columns stay, odd rows pass."""

import re

import corpus_pipeline
from flightloom.llm.shared import staged


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept_by_brute_force(rows):
    """The smallest id of each component of texts with a similarity of 0.8 or more."""
    sets = sorted((i, shingles(t)) for i, t in dict(rows).items() if i is not None)
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i for i in up if top(i) == i}


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, "the other and of this", "en", "src1", 5), (9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "call +1 (456) 555-2186 the and of", "en", None, None), (9003, "call +1 (456) 555-2186 the and of", "en", None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, staged(spark, stage(spark, docs, ""))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if name == "language_id":
            assert docs.where("doc_id in (9001, 9002)").count() == 0
            clean = before.where("length(text) > 200").count()
            assert docs.where("length(text) > 200").count() >= 0.99 * clean
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} - {None} == kept_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert docs.where("doc_id = 9003").count() == 1 and docs.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "pii_pseudonyms":
            assert counts[-1] == counts[-2] and docs.where("text like '%555-2186%'").count() == 0
        if name == "pfair_mixing":
            assert 0 < counts[-1] <= counts[-2] and docs.where("doc_id = 9003").count() == 1
            small = before.groupBy("source").count().where("count < 16").select("source")
            same = lambda df: df.join(small, df["source"].eqNullSafe(small["source"]), "left_semi").count()  # noqa: E731, B023
            assert same(docs) == same(before)
    assert docs.where("not round_trip").count() == 0


def test_mix_keeps_every_document(spark):
    rows = [(i, "t", "en", "big" if i < 2000 else "small", 1) for i in range(2020)] + [(None, "t", "en", "big", 1), (7, "t", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(repr, corpus_pipeline.mix_sources(spark, docs, "").collect())) == sorted(map(repr, docs.collect()))


def test_run_and_empty(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
