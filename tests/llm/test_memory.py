"""Bounds on what one row or batch of the training-data operators holds."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import hpylm, jaccard
from corpusloom.llm.crf import ChainCrf


def test_signatures_hold_a_bounded_number_of_keys_a_row():
    texts = [" ".join(f"w{k}" for k in range(5000)), "a short text of some words", "", "a short text of some words"]
    batch = pa.record_batch(
        [pa.array([1, 2, None, 4], pa.int64()), pa.array(texts), pa.array([5, 6, 7, 8], pa.int64())], names=["id", "text", "raw"])
    rows = [r for b in jaccard._sign(5, 4, 5, 0.25, 0)(iter([batch])) for r in b.to_pylist()]
    assert max(len(r["keys"]) for r in rows) <= 64
    heads = [r for r in rows if r["n"] is not None]
    assert [(r["id"], r["raw"], r["n"]) for r in heads] == [(1, 5, 4996), (2, 6, 2), (None, 7, 0), (4, 8, 2)]
    shingles = jaccard.shingle_sets([texts[0].encode()], 5)[0]
    cut = jaccard.bands(4, 5, 20000)
    own = next(k for k, (low, high) in enumerate(cut) if low <= 4996 <= high)
    wanted = [jaccard.segment_keys(shingles, own + k, k == 0, *cut[own + k], 4, 5, 0.25)
              for k in (0, 1) if k == 0 or 4996 * 5 >= 4 * cut[own + 1][0]]
    got = [(k, i) for r in rows if r["set_id"] == heads[0]["set_id"] for k, i in zip(r["keys"], r["infos"])]
    keys = np.concatenate([w[0] for w in wanted]).view(np.int64).tolist()
    assert got == list(zip(keys, np.concatenate([w[1] for w in wanted]).tolist()))


def test_emissions_in_runs_are_those_of_all_places(monkeypatch):
    rng = np.random.default_rng(3)
    field = ChainCrf(64)
    field.weights[:] = rng.normal(size=64)
    features = rng.integers(0, 64, (7, 11, 5))
    monkeypatch.setattr("corpusloom.llm.crf.PLACES", 10)
    assert (field.emissions(features) == field.weights[features].sum(-1)).all()


def test_states_are_told_in_short_rows_of_few_bytes():
    rng = np.random.default_rng(5)
    pairs = np.zeros(30_000, hpylm._PAIR)
    for name, size in (("word", 3000), ("context", 9000)):
        pairs[name] = rng.integers(0, 1 << 63, size)[rng.integers(0, size, 30_000)]
    pairs["n"] = rng.integers(0, 4, 30_000)
    state = hpylm._State.begun(pairs)
    table = hpylm._state_rows(state.rows(0, 3))
    assert max(len(d) for d in table.column("data").to_pylist() if d is not None) < 100_000
    assert sum(len(d) for d in table.column("data").to_pylist() if d is not None) < 20 * len(state.cells)
    back = hpylm._State.read(table.select(["part", "kind", "source", "data"]))
    for name in ("cells", "words", "contexts"):
        assert (getattr(back, name) == getattr(state, name)).all()
    assert (back.owner == state.owner).all() and (back.place == state.place).all()
    # replies come back in the order of the contexts, whatever part owns them
    asked = [(q, s, d) for q, s, d in zip(*(table.column(c).to_pylist() for c in ("part", "source", "sums"))) if d is not None]
    replies = []
    for q, _, d in asked:
        own = hpylm._rows([(q, hpylm.SUMS, 0, d)])
        replies.append(hpylm._reply((pa.scalar(q),), pa.Table.from_batches([own])))
    told = hpylm._told(pa.concat_tables(replies), state, 3)
    sent = state.sent()
    assert (told["n"] == sent["n"]).all() and (told["t"] == sent["t"]).all()


def test_sweeps_get_only_the_cells_that_move():
    """A sweep over what it is given moves the whole state's cells as a sweep over all of them does."""
    rng = np.random.default_rng(7)
    pairs = np.zeros(30_000, hpylm._PAIR)
    for name, size in (("word", 3000), ("context", 9000)):
        pairs[name] = rng.integers(0, 1 << 63, size)[(size * rng.random(30_000) ** 3).astype(int)]
    pairs["n"] = rng.integers(0, 4, 30_000) ** 5
    whole = hpylm._State.begun(pairs)
    rows = hpylm._state_rows(whole.moving(0, 3))
    told = rows.column("moving").to_pylist()
    assert max(len(d) for d in told) < 100_000
    lean = hpylm._Moving(rows.select(["part", "kind", "source", "moving"]).rename_columns(["part", "kind", "source", "data"]))
    assert len(lean.cells) == (whole.cells["n"] > 1).sum() < len(whole.cells)
    assert (lean.at_classes(lean.cells["t"]) == whole.at_classes(whole.cells["t"])).all()
    lean.begin()
    totals, tables = hpylm.Totals(whole.sums()), whole.sent()["t"].astype(float)
    for sweep in (1, 2):
        whole.sweep(totals, tables, np.random.default_rng(sweep))
        lean.sweep(totals, tables, np.random.default_rng(sweep))
    moved = hpylm._state_rows(lean.moved(0, 2, None)).select(["part", "kind", "source", "data"])
    again = hpylm._State.begun(pairs)
    again.move(moved, 2)
    assert (again.cells == whole.cells).all() and (again.words == whole.words).all()
    assert (lean.seated() == whole.sums()[48:]).all()


def test_pairs_whose_keys_agree_are_told_apart():
    rng = np.random.default_rng(9)
    words, contexts = (rng.integers(0, 1 << 63, 40).astype("u8")[rng.integers(0, 40, 5000)] for _ in range(2))
    words ^= rng.integers(0, 3, 5000).astype("u8")
    contexts ^= rng.integers(0, 3, 5000).astype("u8")
    pairs, inverse = hpylm._added(words, contexts, np.ones(5000))
    want, counts = np.unique(np.stack([words, contexts], 1), axis=0, return_counts=True)
    assert (pairs["word"] == want[:, 0]).all() and (pairs["context"] == want[:, 1]).all() and (pairs["n"] == counts).all()
    assert (pairs["word"][inverse] == words).all() and (pairs["context"][inverse] == contexts).all()


def test_blocks_of_a_task_come_in_any_order():
    """A task may read files of several blocks in any order, in one batch."""
    texts = ["of the first", "a b c d", "more of the first", "e f"]
    batch = pa.record_batch([pa.array([5, 2, 5, 3], pa.int64()), pa.array([True] * 4), pa.array(texts)],
                            names=["block", "train", "text"])
    asked = {}
    for rows in hpylm._count(3)(iter([batch])):
        for r in rows.to_pylist():
            asked[r["source"]] = asked.get(r["source"], 0) + int(hpylm._records(r["data"], hpylm._PAIR)["n"].sum())
    assert asked == {5: 9, 2: 5, 3: 3}
