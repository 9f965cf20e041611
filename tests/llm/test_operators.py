"""The operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontam, exact_dedup, hpylm, htmltext, jaccard, langid, packing, sharding, toxicity, warc
from corpusloom.llm.queries import tokenizer_path
from corpusloom.session import shared_path

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RANDOM = random.Random(3)
VOCABULARY = ["".join(RANDOM.choice("abcdefgh") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]
PASSAGE = " ".join(RANDOM.choice(VOCABULARY) for _ in range(40))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, k, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(k):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return " ".join(words)


BASE = prose(120, 1)
TEXTS = [
    None, "", "  \n\t", "one", "One", "one two", "ONE  two", "Ünï cödé   x", "É é", BASE, BASE, BASE.upper(),
    *[edited(BASE, k, 50 + k) for k in range(1, 14)],
    *[prose(n, 100 + n) for n in (1, 3, 9, 13, 30, 60)],
    prose(300, 7) + " " + PASSAGE + " " + prose(40, 8), PASSAGE, PASSAGE.replace(" ", ", ") + "!", prose(30_000, 9),
    "x" * 70_000, "a" * 5_000 + " " + "b" * 5_000, None, "",
]
CLASHES = ["score", "shard", "n_words", "keep_id", "size", "component_id", "block", "run", "spans", "id", "rejected"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", "xx", None)[k % 3]) for k, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en"), (None, "a text without an id " + prose(30, 11), None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for c in CLASHES:
        made = made.withColumn(c, F.lit("extra"))
    return made


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)


def pairs_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def normal(text):
    return (text or "").encode().translate(LOWER)


def source(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_deep_and_unclosed_pages_take_linear_time():
    import time
    import tracemalloc

    for page in ("<div>x" * 100_000, "<p><b>x</i>" * 50_000, '<div class="a">' * 100_000 + "x" + "</div></p>" * 100_000):
        tracemalloc.start()
        began = time.process_time()
        blocks = htmltext.leaf_blocks(page)
        features = [htmltext._features(b) for b in blocks[-3:]]
        assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
        tracemalloc.stop()
        assert blocks and all(features)
    assert len(htmltext.leaf_blocks("<div>x" * 100_000)) == 100_000


def test_formulas_stay_in_their_sentence():
    page = "<p>a <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>k</mi></msup><annotation>hidden</annotation></math> b</p><object><p>fallback</p></object>"
    assert [b[0] for b in htmltext.leaf_blocks(page)] == ["a x=2k b", "fallback"]


def test_runs_are_sorted_at_every_level(docs, monkeypatch):
    """Blocks hold sorted slices of runs; a round leaves a fan-in-th of the runs and no key twice in a run."""
    digests = exact_dedup.digest_table(docs.repartition(9))
    whole = Counter(r.digest for r in digests.collect())
    runs, bits = exact_dedup.sorted_runs(digests, 2), 2
    n_runs = digests.select("run").distinct().count()
    assert n_runs == 9
    for next_bits in (2, 4, 4, 5):
        blocks, copies = defaultdict(list), Counter()
        for row in sorted(runs.collect(), key=lambda r: (r.run, r.slice)):
            entries = list(exact_dedup.unpacked(row.asDict()))
            assert len(entries) == row.n and {e[0][0] >> (8 - bits) for e in entries} == {row.slice}
            blocks[row.run] += [e[:3] for e in entries]
            copies.update({e[0]: e[4] for e in entries})
        assert copies == whole
        for keys in blocks.values():
            assert keys == sorted(set(keys))
        assert set(blocks) == set(range(n_runs))
        runs, n_runs = exact_dedup.merge_round(runs, 2, bits, next_bits), -(-n_runs // 2)
        bits = next_bits


def test_equal_digests_of_other_texts_stay_apart(spark):
    rows = [(5, 1, bytes(32), 3, 7, 0), (4, 1, bytes(32), 3, 7, 1), (3, 1, bytes(32), 4, 7, 1), (2, 1, bytes(32), 3, 8, 2), (None, 1, bytes(32), 3, 7, 2)]
    digests = spark.createDataFrame(rows, "id long, raw long, digest binary, n_bytes long, checksum long, run long")
    found = exact_dedup.merge_runs(digests, fan_in=2).collect()
    assert sorted((r.n_bytes, r.checksum, r.keep_id, r.copies) for r in found) == [(3, 7, 4, 3), (3, 8, 2, 1), (4, 7, 3, 1)]


def test_runs_in_many_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ENTRIES", 4)
    groups = defaultdict(list)
    for i, t in source(docs):
        groups[normal(t)].append(i)
    found = exact_dedup.merge_runs(exact_dedup.digest_table(docs), "largest", 3).collect()
    assert Counter((r.keep_id, r.copies) for r in found) == Counter((max(i for i in g if i is not None) if any(i is not None for i in g) else None, len(g)) for g in groups.values())


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups(docs, keep, best, fan_in):
    groups = defaultdict(list)
    for i, t in source(docs):
        groups[normal(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keeper = best((i for i in ids if i is not None), default=None)
        want.update((i, keeper, len(ids), i == keeper, hashlib.sha256(text).hexdigest()) for i in ids)
    found = exact_dedup.exact_groups(docs, keep=keep, fan_in=fan_in)
    assert pairs_of(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    stay = exact_dedup.drop_copies(docs, keep=keep, fan_in=fan_in)
    assert stay.columns == docs.columns
    assert Counter(normal(r.text) for r in stay.collect()).keys() == groups.keys()


def test_exact_groups_of_nothing(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_byte_shards(spark, docs, no_docs):
    sized = sharding.sized(docs)
    rows = sharding.byte_shards(sized, 4, order=("doc_id", "text_crc32"), n_ranges=6).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert 0 <= r.shard < 4
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in part) - total / 4) <= largest for part in by.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids) and len(rows) == len(source(docs))
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in rows) == Counter(
        (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in source(docs))
    assert sharding.byte_shards(sharding.sized(no_docs), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(docs, 4)
    path = shared_path(spark, "shards")
    sharding.write_shards(docs.where("doc_id = 9"), sharding.byte_shards(sized, 4).where("doc_id = 9"), path)
    assert spark.read.parquet(path).count() == 1


WEIRD = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 150
PAGES = [
    (1, "http://a/", "z" * 200), (0, "http://b/", "z" * 200), (2, None, "z" * 200), (3, "c\r\nd", "short"), (4, "c", "short"),
    (5, "e", None), (6, "f", ""), (7, "g", WEIRD), (8, "h", WEIRD), (9, "i", "tail\r\n\r\n"), (10, "j", "ü" * 300),
    (None, "k", "z" * 200), (0, "http://b/", "z" * 200), (11, "l", "WARC/1.1\r\n"), (12, "m", "\r\n\r\n" * 60),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("n", F.lit(1))
    path = shared_path(spark, "warc")
    warc.write_archives(warc.capture_records(pages), path, compression)
    rows = warc.captures(spark, path).collect()
    assert len(rows) == len(PAGES)
    firsts = {}
    for i, _, html in PAGES:
        if html and len(html.encode()) >= 100 and i is not None:
            firsts[html] = min(firsts.get(html, i), i)
    want = Counter()
    for i, url, html in PAGES:
        data = (html or "").encode()
        first = firsts.get(html, i) if len(data) >= 100 and i is not None else i
        revisit = first != i
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
              first if revisit else None, None if revisit else data)] += 1
    got = Counter()
    for r in rows:
        assert len(r.requests) == len(r.metadata) == 1
        i = r.metadata[0].fields["captureid"]
        x = r.response
        got[(int(i) if i else None, int(x.fields["content-length"]), x.payload_digest or x.declared_digest, x.record_type,
             int(x.refers_to) if x.refers_to else None, None if x.payload is None else bytes(x.payload))] += 1
    assert got == want


def test_warc_split_archives(spark):
    """Uncompressed archives larger than a split, with payloads that hold version lines."""
    html = "WARC/1.1\r\nWARC/1.0\r\n WARC/1.x " + "x" * 20_000
    pages = spark.createDataFrame([(k, "u", f"{k} {html}") for k in range(40)], "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_archives(warc.capture_records(pages.coalesce(1)), path, "none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        rows = warc.captures(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    told = {r.metadata[0]["fields"]["captureid"]: bytes(r.response.payload).decode() for r in rows}
    assert told == {str(k): f"{k} {html}" for k in range(40)}


def test_warc_foreign_headers(spark, tmp_path):
    def record(version, kind, fields, block, length=None):
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields])
        return f"WARC/{version}\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n{block}\r\n\r\n"

    (tmp_path / "a.warc").write_bytes("".join([
        record("1.0", "response", [("WARC-Record-ID", "<a>")], "first"),
        record("1.1", "response", [("WARC-Record-ID", "<b>")], "not WARC/1.7 a start", "many"),
        record("1.0", "request", [("WARC-Record-ID", "<q>"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")], "get"),
        record("1.1", "metadata", [], "k: 1"),
        record("1.1", "metadata", [], "k: 2", ""),
    ]).encode())
    rows = warc.captures(spark, str(tmp_path)).collect()
    named = {r.capture_id: r for r in rows if r.capture_id}
    assert bytes(named["<a>"].response.payload) == b"first"
    assert bytes(named["<b>"].response.payload) == b"not WARC/1.7 a start"
    assert all([q.record_id for q in named[k].requests] == ["<q>"] for k in ("<a>", "<b>"))
    alone = [r for r in rows if r.capture_id is None]
    assert sorted(r.metadata[0]["fields"]["k"] for r in alone) == ["1", "2"] and all(len(r.metadata) == 1 for r in alone)
    (tmp_path / "b.warc").write_bytes(record("1.1", "response", [], "cut", 99).encode())
    with pytest.raises(Exception, match="ends within a record"):
        warc.captures(spark, str(tmp_path)).collect()


def test_warc_orphans_and_nothing(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_archives(warc.capture_records(pages.limit(0)), path)
    assert warc.captures(spark, path).count() == 0
    path = shared_path(spark, "warc")
    warc.write_archives(warc.capture_records(pages).where("value like '%WARC-Type: request%'"), path)
    assert [len(r.requests) for r in warc.captures(spark, path).collect()] == [1, 1, 1]


def word_list(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", normal(text))


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_overlaps(spark, docs, no_docs, max_bytes):
    items = [(1, PASSAGE), (2, "One two"), (3, None), (4, "  "), (5, BASE), (None, prose(30, 7)), (11, PASSAGE)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = word_list(t)
        for k in range(max(1, len(w) - 12) if w else 0):  # an item without an id hits, but has no name
            windows[tuple(w[k : k + 13])] |= set() if i is None else {str(i)}
    found = decontam.find_overlaps(docs, benchmark, max_bytes=max_bytes, keep_text=True).collect()
    assert len(found) == len(source(docs))
    hits = 0
    for r in found:
        w = word_list(r.text)
        covered, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    covered.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(covered), sorted(names))
        marked = [x for s in r.spans for x in word_list(r.text[s.start : s.end])]
        assert marked == [w[k] for k in sorted(covered)]
        hits += bool(covered)
    assert hits > 5
    assert decontam.find_overlaps(no_docs, benchmark).count() == 0
    assert decontam.find_overlaps(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def brute_components(rows, percent, width):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", normal(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return Counter((i, len(s), name[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("percent, width", [(90, 3), (80, 5), (60, 1), (100, 2)])
def test_similar_groups(docs, percent, width):
    found = jaccard.similar_groups(docs, percent, width)
    assert pairs_of(found, "doc_id", "n_shingles", "component_id") == brute_components(source(docs), percent, width)


def test_similar_groups_of_short_sets(spark):
    rows = [(k, " ".join(sorted(random.Random(k).sample("abcdefghijkl", random.Random(-k).randint(4, 12))))) for k in range(150)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (75, 85):
        found = jaccard.similar_groups(made, percent, 1, spare=0.1)
        assert pairs_of(found, "doc_id", "n_shingles", "component_id") == brute_components(rows, percent, 1)


def test_similar_groups_of_one_spread_out_family(spark):
    """Copies with a few to many words changed: most pairs share segments, and few link."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(160)]
    texts = []
    for k in range(240):
        words = list(base)
        for at in rng.choice(160, size=int(rng.integers(1, 12)), replace=False):
            words[at] = f"x{rng.integers(0, 4000)}"
        texts.append(" ".join(words))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent, width in ((90, 3), (80, 5)):
        found = jaccard.similar_groups(made, percent, width)
        want = brute_components(list(enumerate(texts)), percent, width)
        assert 20 < len({c for _, _, c in want}) < len(texts)
        assert pairs_of(found, "doc_id", "n_shingles", "component_id") == want


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for changed in (0, 1, 17, 200):
        a, b = pool[: 300 + changed], pool[changed:300 + changed]
        one, two = (jaccard.parity_sketch(x, 500).view(np.uint64) for x in (a, b))
        assert int(np.bitwise_count(one ^ two).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_one_of_each(docs, no_docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(source(docs), 80, 5)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in want if i == c}
    assert jaccard.similar_groups(no_docs).count() == 0


@pytest.mark.parametrize("tiers", [packing.TIERS, (4, 16)])
def test_pack(docs, no_docs, tiers):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), tiers, keep_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
        assert len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].tier <= tiers[-1] and not at & (at - 1)
    for i, t in source(docs):
        if i == 5:
            continue  # twice in the table
        ids = [x for r in sorted(documents[i], key=lambda r: r.start) for x in r.ids]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    assert packing.pack(no_docs, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), (3, 8))


def test_hpylm(docs, no_docs):
    train = F.pmod(F.col("doc_id"), F.lit(4)) != 0
    found = hpylm.score(docs, train).collect()
    rows = source(docs)
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", normal(t)) + [None]) for i, t in rows]
    counts = Counter(w for i, ws in words if i is not None and i % 4 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws),
                   sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 * max(1, abs(b[3])) for a, b in zip(got, want))
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in found)
    again = {(r.doc_id, r.n_tokens): r.score for r in hpylm.score(docs, train).collect()}
    assert again == {(r.doc_id, r.n_tokens): r.score for r in found}
    assert hpylm.score(no_docs, train).count() == 0
    assert all(r.n_known == 0 for r in hpylm.score(docs, F.lit(False)).collect())


def test_hpylm_is_a_distribution():
    """In every context the mean probabilities of all known words and of a new one add up to 1."""
    rng = np.random.default_rng(3)
    contexts = [17 * 16 * k + k % 16 for k in range(1, 30)]
    pairs = np.array([(w, c, 0 if w == 60 else rng.poisson(3 / w) * rng.integers(1, 90))
                      for w in range(1, 61) for c in contexts], hpylm._PAIR)
    state, samples = hpylm._State.begun(pairs), 0
    for sweep in range(6):
        totals, told = hpylm.Totals(state.sums()), state.sent()
        if sweep > 1:
            state.sample(totals, told)
            samples += 1
        state.sweep(totals, told["t"].astype(float), rng)
    assert (state.cells["t"] <= state.cells["n"]).all() and (state.cells["t"] > 0).sum() == (pairs["n"] > 0).sum()
    known = np.bincount(state.owner, state.cells["n"])[state.owner] > 0
    one_new = known | (state.cells["word"] == 60)
    assert np.allclose(np.bincount(state.place[one_new], state.cells["sum"][one_new]) / samples, 1, atol=1e-4)


def test_hpylm_counts_past_32_bits():
    big = 3_000_000_000
    pairs = np.array([(5, 16, big), (5, 16, big), (6, 16, 1)], hpylm._PAIR)
    state = hpylm._State.begun(pairs)
    assert state.cells["n"].tolist() == [2 * big, 1]
    back = hpylm._records(hpylm._bytes(state.cells), hpylm._CELL)
    assert back["n"].tolist() == [2 * big, 1] and hpylm.Totals(state.sums()).all == 2 * big + 1


def test_hpylm_beats_counts_on_held_out_texts(spark):
    """Words that follow few others: perplexity of held-out texts falls well below that of single words."""
    r = random.Random(11)
    after = {k: r.sample(range(200), 4) for k in range(200)}

    def walk():
        at, out = r.randrange(200), []
        for _ in range(60):
            out.append(f"w{at}")
            at = r.choice(after[at])
        return " ".join(out)

    made = spark.createDataFrame([(k, walk()) for k in range(300)], "doc_id long, text string")
    rows = [x for x in hpylm.score(made, F.col("doc_id") % 10 != 0).collect() if x.held_out]
    tokens = sum(x.n_tokens for x in rows)
    assert len(rows) == 30
    assert sum(x.score for x in rows) / tokens > sum(x.base_score for x in rows) / tokens + 1


def test_language(spark, no_docs):
    r = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "och", "ung"], "cc": ["eau", "ée", "que"]}
    rows = [(k, " ".join("".join(r.choice(parts[x]) for _ in range(3)) for _ in range(30)), x)
            for k, x in enumerate(list(parts) * 40)]
    extra = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "kalomi", None), (904, "que " * 40_000, None)]
    made = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    identifier = langid.fit(made, F.col("doc_id") % 5 != 0, rows_per_language=20)
    found = {x.doc_id: x for x in langid.identify(made, identifier).collect()}
    assert all(found[k].lang_pred == x for k, _, x in rows)
    assert [found[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert found[904].lang_pred == "cc" and all(0 <= x.score <= 1 for x in found.values())
    assert langid.identify(no_docs, identifier).count() == 0
    assert langid.fit(made, F.lit(False)) is None
    assert {x.lang_pred for x in langid.identify(made, None).collect()} == {"und"}


def test_model_adds_up():
    texts = ["kalo mika", "lomi ka"]
    letters = langid.alphabet(texts)
    codes, firsts, _ = langid.symbols(texts, langid.symbol_table(letters))
    model = langid.Model(codes[firsts[0] : firsts[-1]], len(letters) + 2)
    every = np.arange(len(letters) + 2, dtype=np.uint64)
    for context in (0, 1, 3 << 16 | 2, 5 << 32 | 12345):
        assert abs(np.exp(model.log_prob(np.uint64(context << 16) | every)).sum() - 1) < 1e-9


def test_every_taught_letter_has_a_symbol():
    """Languages that differ in letters beyond a-z alone are told apart; case folds, new letters share one symbol."""
    letters = langid.alphabet(["Єґ éß 日本 ϑ", "єєґ"])
    table = langid.symbol_table(letters)
    own = [int(table[ord(c)]) for c in "єґéß日本ϑ"]
    assert len(set(own)) == 7 and min(own) >= 2 and table[ord("Є")] == table[ord("є")] == 2
    assert table[ord("a")] == table[ord("я")] == 1 and table[ord(" ")] == table[ord("7")] == 0


def test_languages_of_other_letters(spark, monkeypatch):
    r = random.Random(8)
    base = ["мо", "на", "ре"]
    rows = [(k, " ".join("".join(r.choice(base) for _ in range(3)) + "єґ"[k % 2] for _ in range(20)), "xy"[k % 2]) for k in range(60)]
    made = spark.createDataFrame(rows + [rows[0]] * 50, "doc_id long, text string, lang string")
    identifier = langid.fit(made, F.col("doc_id") % 5 != 0, rows_per_language=12)
    assert all(x.lang_pred == rows[x.doc_id][2] for x in langid.identify(made, identifier).collect())
    # a cache of few slots gives the same scores
    want = identifier.entropies([t for _, t, _ in rows])[0]
    identifier._forget()
    monkeypatch.setattr(langid, "KEPT_SCORES", 64)
    assert np.allclose(identifier.entropies([t for _, t, _ in rows])[0], want)
    monkeypatch.setattr(langid, "BYTES_PER_LANGUAGE", 1)  # two whole texts of each are still taken
    assert langid.fit(made, F.lit(True)).languages == ["x", "y"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(made, F.lit(True))


def test_toxicity(spark, no_docs):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(5, 150))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = "vexo" + r.choice(["", "in", "ulta", "rem"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Vexounseen at the start"), (903, prose(20_000, 3)), (904, "12 34")]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    known = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(made, known, F.col("doc_id") % 5 != 0)
    found = {x.doc_id: x for x in toxicity.score(made, model).collect()}
    wrong = [k for k, t in labels if (found[k].score >= 0.3) != bool(t)]
    assert len(wrong) <= 4 and all(0 <= x.score <= 1 for x in found.values())
    text = dict(rows)
    assert all("vexo" in text[k][s.start : s.end].lower() for k in found for s in found[k].spans if k in range(0, 400, 4))
    assert found[902].score >= 0.3 and found[902].spans[0].start == 0
    assert all(found[k].score < 0.3 and not found[k].spans for k in (900, 901, 903, 904))
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.fit(made, known.limit(0), F.lit(True))
    assert all(0 <= x.score <= 1 for x in toxicity.score(made, nothing, keep_text=True).collect())


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Repeats of a row teach once, and whole texts come in up to the bound in bytes."""
    rows = [(k, prose(30, k) + (" vexo vexin" if k % 3 == 0 else "")) for k in range(90)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    sizes = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, *rest: sizes.append([len(t) for t in texts]) or plain(texts, *rest))
    for docs in (once, once.unionAll(once).unionAll(once)):
        toxicity.fit(docs, known, F.lit(True))
    assert sizes[0] == sizes[1] and len(sizes[0]) == 90
    monkeypatch.setattr(toxicity, "BYTES_PER_CLASS", 1000)
    toxicity.fit(once, known, F.lit(True))
    assert 2 <= len(sizes[2]) < 90 and sum(sizes[2]) <= 2000


def test_crf_marginals_and_viterbi():
    import itertools

    import numpy as np

    from corpusloom.llm.crf import ChainCrf

    rng = np.random.default_rng(1)
    field = ChainCrf(4)
    field.steps, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores = rng.normal(size=(3, 6))
    lengths = np.array([6, 4, 1])
    got = field.marginals(scores, lengths)
    for k, n in enumerate(lengths):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            s = field.start[y[0]] + sum(scores[k, t] for t in range(n) if y[t]) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))
            weights[y] = math.exp(s)
        z = sum(weights.values())
        for t in range(n):
            assert abs(got[k, t] - sum(w for y, w in weights.items() if y[t]) / z) < 1e-9
        assert tuple(field.viterbi(scores[k, :n])) == max(weights, key=weights.get)


def test_main_text(spark):
    pages = [
        (1, "<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>The &amp; title</h1><p><b>Bold.<br><p>Some  text\nhere"
            "<script>var a='</p>'</script> on.</article><aside>Side</aside><footer>&copy; us</footer>"),
        (2, None), (3, ""), (4, "<!-- <p>no</p> --><script>x"), (5, "<p>a < b"), (6, "<article>" + "<p>word " * 3000),
    ]
    made = spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("x"))
    found = {r.page_id: r for r in htmltext.extract(made).collect()}
    assert found[1].text == "The & title\nBold.\nSome text here on."
    assert [found[k].text for k in (2, 3, 4)] == ["", "", ""] and found[6].text.count("\n") == 2999
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert htmltext.extract(made.limit(0)).count() == 0


def test_blocks_of_held_out_layouts():
    field, wrong, total = htmltext.trained(), 0, 0
    for seed in range(50_000, 50_150):
        page, labels = htmltext.labelled_page(seed)
        blocks = htmltext.leaf_blocks(page.replace("\ue000", "").replace("\ue001", ""))
        if blocks and len(blocks) == len(labels):
            got = field.viterbi(field.emissions(htmltext.page_features(blocks)))
            wrong, total = wrong + sum(int(a) != b for a, b in zip(got, labels)), total + len(labels)
    assert total > 1000 and wrong <= 0.02 * total


def test_hpylm_contexts_are_whole_words(spark):
    """Words whose last two bytes agree keep histories of their own."""
    texts = ["xxing aa", "yying bb"] * 30
    asked = ["xxing aa", "xxing bb", "yying bb", "yying aa"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(asked)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(made, F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 0.5 and got[1002] > got[1003] + 0.5


def test_hpylm_of_many_parts(docs, monkeypatch):
    """Dealing words and contexts into parts changes no count, and scores only as another draw does."""
    train = F.pmod(F.col("doc_id"), F.lit(4)) != 0
    one = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in hpylm.score(docs, train).collect())
    monkeypatch.setattr(hpylm, "PART_BYTES", 40_000)
    many = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in hpylm.score(docs, train).collect())
    assert [x[:3] for x in one] == [x[:3] for x in many]
    assert all(abs(a[3] - b[3]) < 1e-6 * max(1, abs(a[3])) for a, b in zip(one, many))
    assert all(abs(a[4] - b[4]) < 0.05 * abs(a[4]) + 0.3 for a, b in zip(one, many))


def test_hpylm_seats_by_the_exact_distribution():
    """Tables of a cell, moved on from sweep to sweep, against their exact distribution."""
    rng, d, others = np.random.default_rng(1), 0.6, 300.0
    ways = np.full((201, 201), -np.inf)
    ways[1, 1] = 0
    for n in range(1, 200):
        ways[n + 1, 1:] = np.logaddexp(ways[n, :-1], np.log(np.maximum(n - d * np.arange(1, 201), 1e-300)) + ways[n, 1:])
    for n, p in ((5, 0.1), (40, 0.05), (200, 0.02)):
        t = np.arange(1, n + 1)
        weight = ways[n, 1 : n + 1] + np.concatenate([[0], np.cumsum(np.log((1 + d * (others + t[:-1])) * p))])
        share = np.exp(weight - weight.max())
        mean = (share * t).sum() / share.sum()
        spread = ((share * t * t).sum() / share.sum() - mean**2) ** 0.5
        now = np.ones(2000, int)
        for _ in range(12):
            now = hpylm.reseat(np.full(2000, n), now, np.full(2000, others), np.full(2000, d), np.full(2000, p), rng)
        assert abs(now.mean() - mean) < 0.03 * mean and abs(now.std() - spread) < 0.1 * spread


def test_chunks_are_coded_as_the_tokenizer_codes_texts():
    from tokenizers import Tokenizer

    tokenizer, coder = Tokenizer.from_file(tokenizer_path()), packing.ChunkEncoder(tokenizer_path())
    texts = ["café", "un café, é!", "ΟΔΟΣ, ΟΔΟΣ.", "İ. Iİ, x", "Word, word. WORD!? it's", "ﬁn, Straße; ÀÉ… «x»"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_one_of_each_takes_out_rows_not_ids(spark):
    near, clean = edited(BASE, 1, 77), prose(60, 901)
    rows = [(None, near), (None, clean), (7, BASE), (3, prose(50, 902)), (9, prose(70, 903)), (9, prose(50, 902) + " end")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [rows[k] for k in (1, 2, 3, 4)]
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for i, t in want)


def test_all_features_of_a_block_count():
    utility = " ".join(a + b for a in "abcdefgh" for b in "ijklmnop")
    page = f'<div class="{utility}"><div class="sidebar widget"><p>some words of an advert</p></div></div>'
    (block,) = htmltext.leaf_blocks(page)
    field = htmltext.trained()
    assert {htmltext._bucket(f"word:{w}") for w in ("sidebar", "widget")} <= set(htmltext._features(block))
    assert np.allclose(field.emissions(htmltext.page_features([block])), htmltext.emissions([block], field))
    article = "".join(f"<p>{prose(30, k)}.</p>" for k in range(4))
    wrapped = htmltext.main_text(f'<div class="{utility}"><article>{article}</article><div class="sidebar widget"><p>Some words</p></div></div>', field)
    assert wrapped.count("\n") == 3 and "Some words" not in wrapped
