"""Texts longer than a chunk of 1 MB, and words longer than 1 kB, against brute force on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from flightloom.llm import divergence, exact_dedup, interactions, kernels, language_id, minhash, pii, sentencepiece_bpe, suffix_array, suffix_tree


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Two long texts that share a passage far from their starts, a copy of one with an edited word, a short one with the passage, long words."""
    passage = words(1, 80)
    one, two = words(2, 160_000), words(3, 160_000)
    one[150_000:150_080] = passage
    two[159_000:159_080] = passage
    edited = list(one)
    edited[80_000] = "edited"
    out = {1: " ".join(one), 2: " ".join(two), 3: " ".join(edited), 4: "short text " + " ".join(passage), 5: "x" * 5000 + " " + "y" * 3000, 6: "x" * 5000 + " " + "y" * 2999}
    assert all(len(out[i]) > kernels.CHUNK_BYTES for i in (1, 2, 3))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_passages(docs, texts):
    cut = {i: t.split(" ") for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 49):
            first.setdefault(tuple(cut[i][k : k + 50]), i)
    got = {r.id: r for r in suffix_tree.passage_dedup(docs, window=50).collect()}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), i


def test_bytes(spark, docs, texts):
    got = {r.id: r for r in suffix_array.substring_dedup(docs.where("doc_id in (2, 4)")).collect()}
    shared = " " + texts[4].removeprefix("short text ")
    assert len(shared) > 200 and got[4].n_removed in (len(shared), len(shared) - 1)
    assert got[2].n_removed >= len(shared) and got[2].n_bytes == len(texts[2])


def test_near_copies(docs):
    got = {r.id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True)}


def test_tokens(docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_bpe.encode_texts(docs.where("doc_id in (1, 5)"), path, most_kept=1000).collect():
        assert list(r.ids) == sp.encode(texts[r.id], add_eos=True) and r.decoded == texts[r.id]


def test_language_and_personal_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(table.where(~language_id.held_out("doc_id")), docs_per_lang=200)
    one = table.where("n_chars between 1000 and 4000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    long = one.select("lang", F.expr("repeat(text, cast(1200000 / length(text) as int))").alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    assert all(len(r.text) > 1_000_000 for r in long.collect())
    found = language_id.predict(long, model, keep=["lang"]).collect()
    assert len(found) == 4 and all(r.lang == r.lang_pred for r in found)
    hidden = long.withColumn("text", F.concat("text", F.lit("card 4041894974608795 end")))
    made = pii.pseudonymise(hidden, "k", count_col="n")
    assert all(r.n == 1 and "4041894974608795" not in r.text for r in made.collect())


def test_copies_terms_and_filters(spark, docs, texts):
    got = {r.id: r for r in exact_dedup.mark_copies(docs.unionByName(docs.where("doc_id = 1").withColumns({"doc_id": F.lit(9).cast("long"), "text": F.upper("text")}))).collect()}
    assert got[1].keep_id == 9 and not got[1].kept and got[1].text_sha256 == got[9].text_sha256 == hashlib.sha256(texts[1].encode()).hexdigest()
    counted = {r.term: (r.n, r.docs) for r in divergence.term_counts(docs).where("term in ('edited', 'short') or length(term) >= 2999").collect()}
    assert counted == {"edited": (1, 1), "short": (1, 1), "x" * 5000: (2, 2), "y" * 3000: (1, 1), "y" * 2999: (1, 1)}
    bits = {r.bits for r in interactions.flagged(docs.where("doc_id in (1, 5)"), spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert bits == {0, 1 | 1 << interactions.GOOD | 1 << interactions.TOXIC}
