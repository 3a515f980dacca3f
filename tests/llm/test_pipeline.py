"""The pipeline's stages against plain Python on a small corpus with planted cases, on the small tables, and on none."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from siftwork.llm import near_dedup, packing, quality_fm

DIR = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose, junk, a shared line, copies, near copies, blanks, a repeated row and rows without ids, in three sources; every second one is labelled."""
    line = "This is a line that many of the documents hold"
    rows = []
    for i in range(90):
        text = prose(i, 120)
        if i % 3 == 0:
            text = " ".join(f"{w}### $$$" for w in text.split())
        elif i % 7 == 1:
            text = f"{text}\n {line.upper() if i % 2 else line}\nown end {i}"
        rows.append((i, text, "en", ("a", "b", None)[i % 3 if i % 5 else 2], len(text)))
    base = prose(1000, 300).split()
    for i in range(100, 106):
        own = [f"x{i}" if j == i else w for j, w in enumerate(base)]
        rows.append((i, " ".join(own), "en", "a", 1))
    rows += [(110, prose(2, 120), "de", "b", 1), (111, None, None, "a", None), (112, "", "en", "b", 0), (113, f"{line}\n{line}", "en", "a", 2), rows[1], (None, prose(5000, 80), "en", "b", 3), (None, prose(5001, 80), "en", "b", 3)]
    home = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return home


def rows_of(df):
    return sorted((tuple(r[c] for c in cp.COLUMNS) for r in df.collect()), key=repr)


def plain_quality(spark, rows, home):
    docs = spark.createDataFrame(rows, KIND)
    fm = quality_fm.train_quality(docs, spark.read.parquet(f"{home}/labels.parquet"))
    out = []
    for r in rows:
        at, x, s = quality_fm.hashed_row((r[1] or "").encode(), fm.bits, (None if r[4] is None else float(r[4]),))
        at, x = quality_fm._whole(at, x, s, fm.bits, fm.mean, fm.deviation)
        z = fm.bias + fm.weights[at] @ x + sum(float(fm.factors[at[i]] @ fm.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        if 1 / (1 + np.exp(-z)) >= 0.5:
            out.append(r)
    return out


def plain_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(-1 if i is None else i)
    out = []
    for i, t, lang, source, n in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        if len(kept) == len(lines):
            out.append((i, t, lang, source, n))
        elif WORD.search("\n".join(kept)):
            out.append((i, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def plain_near(spark, rows):
    """One row of each class, by all pairs; rows without words all stay."""
    idf = near_dedup.shingle_idf(spark.createDataFrame(rows, KIND), "text", 5)
    v = [near_dedup.weighted_shingles((r[1] or "").encode(), idf) for r in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(v[i], v[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if WORD.search(r[1] or "") else ("blank", i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def plain_mixture(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(x for x in size if x is not None) + [x for x in size if x is None]
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        if not (over := {s for s in names if s not in full and target[s] > 3 * size[s]}):
            break
        full |= over
    out = []
    for r in rows:
        rate = target[r[3]] / size[r[3]] if size[r[3]] else 0.0
        name = str(r[0]) if r[0] is not None else "null:" + hashlib.md5((r[1] or "").encode()).hexdigest()
        toss = int(hashlib.md5(f"42:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [r] * (int(rate) + (toss < rate - int(rate)))
    return out


def check_packed(pieces, rows):
    encode = packing.slow_encoder("byte_bpe_50k").encode
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[i, s, len(ids), zlib.crc32(ids[s : s + 1024].tobytes())] += 1
    assert Counter((p["doc_id"], p["start"], p["doc_tokens"], zlib.crc32(bytes(p["ids"]))) for p in pieces) == want
    at = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]] and len(p["ids"]) == 4 * p["length"]
        at[p["sequence_id"]] += p["length"]
    assert max(at.values()) <= 1024
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in at.values())
    assert pad <= 1024 + 0.05 * sum(at.values())


def test_stages_and_run_against_plain_python(spark, corpus):
    rows = rows_of(spark.read.parquet(f"{corpus}/documents.parquet"))
    plain = {"quality": lambda r: plain_quality(spark, r, corpus), "lines": plain_lines, "near_duplicates": lambda r: plain_near(spark, r), "mixture": plain_mixture}
    counts = []
    for name, stage in cp.STAGES[:-1]:
        got = rows_of(stage(spark, spark.createDataFrame(rows, KIND).repartition(2), corpus))
        assert got == sorted(plain[name](rows), key=repr), name
        counts.append(len(got))
        rows = got
    assert counts[0] < 103 and counts[2] <= counts[1] - 6  # junk goes; copies and near copies come down to one each
    assert {r[0] for r in rows} & set(range(100, 106)) <= {100}
    check_packed(cp.packing(spark, spark.createDataFrame(rows, KIND), corpus).collect(), rows)
    check_packed(cp.run(spark, corpus).collect(), rows)


def test_stages_on_the_small_tables_and_on_none(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), DIR)
        docs = cp.saved(stage(spark, docs, DIR), name)
        assert empty.columns == docs.columns and empty.count() == 0
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    assert docs.count() > 0


def test_columns_that_clash_are_left_behind(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(20).selectExpr("*", "1 as line_kept", "2 as mix_copies", "3 as quality_score", "4 as near_key", "5 as ids")
    for name, stage in cp.STAGES[1:]:
        out = stage(spark, docs, DIR)
        assert out.count() > 0 and (name == "packing" or out.columns == cp.COLUMNS)


def test_a_hot_group_of_edited_copies_comes_down_to_one(spark):
    r = np.random.default_rng(40)
    base, rows = [f"w{i}" for i in r.integers(0, 5000, 300)], []
    for i in range(300):
        t = list(base) if i % 3 == 0 else [f"w{x}" for x in r.integers(0, 5000, 120)]
        for j in r.choice(len(t), 2, replace=False):
            t[j] = f"x{i}_{j}"
        rows.append((i, " ".join(t), "en", "a", 1))
    docs = spark.createDataFrame(rows, KIND)
    kept = cp.near_duplicates(spark, docs, DIR)
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == [i for i in range(300) if i == 0 or i % 3]
