"""The registered queries themselves, on small folders of tables or on those given, against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import line_dedup, packing, quality_fm, quality_rules, registry, token_rollups, toxicity_chain
from siftwork.llm.common import texts_of

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: "bad" and two bytes that aren't UTF-8, as Spark's strings can hold them.
BAD = r"cast(x'626164fffe' as string)"


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


@pytest.fixture(scope="module")
def half(spark, tmp_path_factory):
    """The documents of the tables with the labels of odd ids alone."""
    home = str(tmp_path_factory.mktemp("half"))
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{home}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 2 = 1").write.parquet(f"{home}/labels.parquet")
    return home


def test_every_query_says_what_it_does():
    assert len(registry.QUERIES) == 10 and all(f.__doc__ for f in registry.QUERIES.values())


def test_op2_on_rows_it_never_learnt_from(spark, half, tables):
    """The chain by hand: each link's log odds from its own words and the links before it. Held out: most toxic rows, hardly a false alarm."""
    docs, labels = tables
    out = {r["doc_id"]: r for r in toxicity_chain.op2_toxicity_chain(spark, half).collect()}
    assert out.keys() == docs.keys()
    frame = spark.read.parquet(f"{half}/documents.parquet")
    chain = toxicity_chain.train_toxicity(frame, spark.read.parquet(f"{half}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic"), ["junk", "toxic"])
    for i in list(docs)[::25]:
        words, p = set(toxicity_chain.distinct_words(docs[i]).tolist()), []
        for link in chain:
            z = link.bias + sum(w * np.log(q / (1 - q)) for w, q in zip(link.earlier, (min(max(q, 1e-3), 1 - 1e-3) for q in p), strict=True))
            z += sum(w for k, w in zip(link.keys.tolist(), link.weights, strict=True) if k in words)
            p.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert np.allclose([out[i]["junk_probability"], out[i]["score"]], p, atol=1e-9) and out[i]["predicted"] == int(p[1] >= chain[1].threshold)
    unseen = [i for i in labels if i % 2 == 0]
    toxic = [i for i in unseen if labels[i]["toxic"]]
    assert sum(out[i]["predicted"] for i in toxic) >= 0.5 * len(toxic) and sum(out[i]["predicted"] for i in unseen) - sum(out[i]["predicted"] for i in toxic) <= 0.03 * len(unseen)


def test_op10_on_held_out_rows(spark, tables):
    docs, labels = tables
    out = {r["doc_id"]: r for r in quality_fm.op10_quality_fm(spark, SF).collect()}
    assert out.keys() == docs.keys() and all(r["held_out"] == is_held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in out.items())
    unseen = [i for i in labels if is_held(i)]
    assert len(unseen) > 50 and np.mean([out[i]["predicted"] == labels[i]["quality"] for i in unseen]) >= 0.97


def test_op10_never_sees_held_out_labels(spark, half, tmp_path):
    """Turned labels of held-out rows change no score."""
    docs, labels = spark.read.parquet(f"{half}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    got = []
    for name, label in (("a", F.col("quality")), ("b", F.when(quality_fm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumn("quality", label).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got.append({r["doc_id"]: r["score"] for r in quality_fm.op10_quality_fm(spark, f"{tmp_path}/{name}").collect()})
    assert got[0] == got[1]


def test_a_score_at_the_limit_and_none(spark):
    fm = quality_fm.FactorisationMachine(4, float(np.log(0.7 / 0.3)), np.zeros(40), np.zeros((40, 2)), np.zeros(18), np.ones(18))
    got = quality_fm.score_quality(spark.createDataFrame([("a b",), (None,)], "text string"), fm).select((F.col("quality_score") >= 0.7 - 1e-12).alias("x")).collect()
    assert all(r["x"] for r in got) and quality_fm.score_quality(spark.createDataFrame([], "text string"), fm).count() == 0


def test_metadata_counts_and_may_lack(spark):
    rows = [(i, "same words", 100.0 if i % 2 else 1.0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars double")
    model = quality_fm.train_quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert model.metadata == ("n_chars",)
    score = lambda df: {r["doc_id"]: r["quality_score"] for r in quality_fm.score_quality(df, model).collect()}
    own = score(docs)
    assert min(own[i] for i in range(1, 80, 2)) > max(own[i] for i in range(0, 80, 2))
    assert len(score(docs.drop("n_chars"))) == 80 and len(score(docs.withColumn("n_chars", F.lit(float("nan"))))) == 80
    assert quality_fm.train_quality(docs.drop("n_chars"), docs.selectExpr("doc_id", "1 as quality")).metadata == ()


def test_op7_on_the_tables(spark, tables):
    docs, _ = tables
    encode = packing.slow_encoder("byte_bpe_50k")
    want, total = {}, 0
    for i, t in docs.items():
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want[i] = ids
    at, used = Counter(), 0
    for r in sorted(packing.op7_packing(spark, SF).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
        used += r["length"]
    assert used == total and max(at.values()) <= 1024
    assert sum(1024 - n for n in at.values() if n & (n - 1)) <= 0.02 * total


def test_op1_digests(spark, tmp_path):
    rows = [(i, f"u{i}", html) for i, html in enumerate(["a", "b", "a", None, "", "é" * 40_000, "é" * 40_000])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in registry.QUERIES["op1_warc"](spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {0: ("response", None), 1: ("response", None), 2: ("revisit", 0), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("revisit", 5)}


def test_bytes_that_are_not_text(spark):
    """They count as U+FFFD wherever Python reads a text."""
    docs = spark.sql(f"select cast(id as long) as doc_id, {BAD} as text, 'a' as source, 'en' as lang, 0 as tokenizer, 1 as n_tokens, 2 as p_toxic, 3 as ids from range(3)")
    whole = "bad��"
    lines = line_dedup.dedup_lines(docs, least_chars=1)
    assert sorted((r["doc_id"], r["line_kept"]) for r in lines.collect()) == [(0, ""), (1, ""), (2, whole)]
    ids = packing.encoder()([whole])[0]
    assert {bytes(r["ids"]) for r in packing.pack(docs).collect()} == {np.array([*ids, 0], "<u4").tobytes()}
    counted = token_rollups.count_tokens(docs, ["byte_bpe_50k"])
    assert [r["_n_tokens"] for r in counted.collect()] == [len(ids)] * 3 and counted.where("_tokenizer = 'byte_bpe_50k'").count() == 3
    chain = toxicity_chain.train_toxicity(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), ["toxic"])
    assert toxicity_chain.score_toxicity(docs, chain).columns == ["doc_id", "p_toxic", "is_toxic"] and toxicity_chain.score_toxicity(docs, chain).count() == 3
    model = quality_fm.train_quality(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert quality_fm.score_quality(docs, model).count() == 3


def test_very_long_words_and_texts(spark):
    long_word, many = "x" * 1_000_000, "ab cd ef gh " * 60_000
    df = spark.createDataFrame([(1, long_word), (2, many)], "doc_id long, text string")
    want = {i: len(packing.encoder()([t])[0]) + 1 for i, t in ((1, long_word), (2, many))}
    assert {r["doc"]: r["n"] for r in packing.pack(df).groupBy("doc").agg(F.sum("length").alias("n")).collect()} == want
    got = {r["id"]: r for r in quality_rules.text_statistics(df).collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_repeat_words"]) == (1, 1_000_000, 0) and (got[2]["n_words"], got[2]["word_chars"], got[2]["n_repeat_words"]) == (240_000, 480_000, 240_000)


@given(st.lists(st.sampled_from([" " * 60_000, "\n" * 50_000, " \n" * 30_000, "a", "é.", " b", "\t"]), max_size=6))
@settings(max_examples=25, deadline=None)
def test_runs_of_white_space_on_either_side_of_the_border(parts):
    text = "".join(parts)
    assert packing.encoder()([text])[0] == packing.slow_encoder("byte_bpe_50k").encode(text, add_special_tokens=False).ids


def test_texts_of_a_column():
    import pyarrow as pa

    assert texts_of(pa.array(["a", None, ""])) == ["a", "", ""]
