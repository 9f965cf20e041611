"""Every stage of the pipeline against a brute-force version on a small table, and the whole of it."""

import os
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from conftest import DATA  # noqa: E402

SF = f"{DATA}/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def bench_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text)) if w]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with planted cases: nulls, copies, near copies, a repeated id, benchmark passages."""
    real = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(bench_words(r.text)) >= 13]
    long = [r for r in real if len((r[1] or "").split()) > 150][:6]
    rows = list(real)
    for k, r in enumerate(long):
        words = r[1].split()
        near = " ".join([*words[:40], "different", *words[41:]])
        rows += [(10_000 + k, r[1], r[2], "copy", None), (10_100 + k, r[1].upper(), r[2], "copy", 1), (10_200 + k, near, r[2], "near", 1)]
    rows += [(10_300 + k, text, "en", "leak", 1) for k, text in enumerate(items[:5])]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "x", 0), (None, "nobody has this text " * 3, "en", "x", 1), (None, None, "en", "x", 1)]
    rows += [(long[0][0], "an id that is there already", "en", "x", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def stage(name):
    return dict(P.STAGES)[name]


def test_toxicity_stage(spark, docs):
    """The small table has too few labels to reject anything; this stage runs on the next larger one, with the odd rows."""
    larger = f"{DATA}/sf0.01"
    odd = docs.where("doc_id is null or doc_id >= 20000")
    rows = spark.read.parquet(f"{larger}/documents.parquet").unionByName(odd)
    kept = stage("toxicity")(spark, rows, larger)
    assert kept.columns == rows.columns
    scores = {(r.doc_id, r.text): r.score for r in P.toxicity.score(rows, P.toxic_model(spark, larger), keep_text=True).collect()}
    want = Counter({row: n for row, n in rows_of(rows).items() if scores[row[0], row[1]] < P.TOXIC_AT})
    assert rows_of(kept) == want and rows_of(kept) > rows_of(odd)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    gone = [toxic[row[0]] for row in rows_of(rows) - rows_of(kept) if row[0] in toxic]
    assert sum(gone) >= 0.8 * len(gone) > 0 and sum(gone) >= 0.5 * sum(toxic.values())  # learned from about 300 labels


def test_exact_stage(spark, docs):
    kept = rows_of(stage("exact_dedup")(spark, docs, SF))
    groups = {}
    for row in docs.select(COLUMNS).collect():
        groups.setdefault(lowered(row.text), []).append(tuple(row))
    want = Counter()
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        want.update(m for m in members if m[0] == max(ids, default=None))
    assert kept == want and sum(kept.values()) < docs.count()


def test_near_stage(spark, docs):
    kept = rows_of(stage("ngram_jaccard_join")(spark, docs, SF))
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i])
    left = Counter(kept)
    for one in members.values():
        # exactly one text of each group stays (rows equal in id and text stay together)
        found = {row for row in one if left[row]}
        assert len({(r[0], r[1]) for r in found}) == 1
    assert not kept - Counter(rows)
    assert len(members) < len(rows)


def test_decontamination_stage(spark, docs):
    kept = rows_of(stage("decontamination")(spark, docs, SF))
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = bench_words(item.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    want = Counter()
    for row in docs.select(COLUMNS).collect():
        w = bench_words(row.text)
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            want[tuple(row)] += 1
    assert kept == want and sum(want.values()) < docs.count()


def test_packing_stage(spark, docs):
    pieces = stage("packing")(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_stages_of_an_empty_table(spark, docs):
    for name, run in P.STAGES:
        out = run(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_applies_the_stages_in_order(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, run in P.STAGES[:-1]:
        docs = P.write_through(run(spark, docs, SF), "by-hand")
    want = Counter({r.doc_id: r.text for r in docs.collect()}.keys())
    pieces = P.run(spark, SF).select("doc_id", "start", "doc_tokens", F.col("length")).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == want
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)
