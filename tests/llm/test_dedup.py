"""Near, exact and line dedup against brute force."""

import hashlib

import numpy as np
import pytest

from kairolake.llm import exact_dedup, graph, line_dedup, near_dedup


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("cfg", "bucket"), [(near_dedup.NearDedupConfig(shingle=3, percent=85), 4), (near_dedup.NearDedupConfig(), 4), (near_dedup.NearDedupConfig(shingle=3, percent=85, small_bucket=1, block_bytes=3000), 1)])
def test_near_duplicates_match_brute_force(spark, docs, cfg, bucket):
    """Also where every bucket goes the way of the large ones, in blocks of a few documents."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rng = np.random.default_rng(1)
    base = [words[i] for i in rng.integers(0, len(words), 150)]
    chain = []
    for i in range(40):  # a chain of copies, each a few words away from the one before
        base = list(base)
        base[rng.integers(0, 150)] = f"new{i}"
        chain.append((10_000 + i, " ".join(base)))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + chain
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()}
    assert got == brute_components(rows, cfg.shingle, cfg.percent)


def test_near_duplicates_edge_cases(edge, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(edge, near_dedup.NearDedupConfig(shingle=3, percent=85)).collect()}
    assert got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[3][1] == 2 and not got[3][2]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    cfg = near_dedup.NearDedupConfig()
    s = near_dedup.SetSketch(cfg)
    x = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2600], x[400:]
    assert (s(np.union1d(a, b)) == near_dedup.SetSketch.merge(s(a), s(b))).all()
    p, q = s(a), s(b)
    est, ok = near_dedup.plausible(cfg, np.array([2600]), np.array([2600]), np.array([(p > q).sum()]), np.array([(p < q).sum()]))
    assert abs(est[0] - 2200 / 3000) < 0.15 and ok[0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[101] == 100
    assert graph.connected_components(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_dedup(spark, docs, edge, empty, support):
    for df in (docs, edge):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        groups = {}
        low = lambda t: (t or "").translate(line_dedup.LOWER)
        for i, t in rows:
            groups.setdefault(low(t), []).append(i)
        want = sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
        assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df, support=support).collect()) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_lines(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(line_dedup.SPACE).translate(line_dedup.LOWER)
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(x.strip(line_dedup.SPACE).translate(line_dedup.LOWER), {i})) > 1 and min(h) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(docs, edge, empty, monkeypatch):
    for df in (docs, edge):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert sorted(tuple(r) for r in line_dedup.dedup_lines(df, digest=True).collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty).count() == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)  # the way for filters too large to broadcast
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs, digest=True).collect()) == brute_lines(rows)


def test_lines_are_looked_up_by_one_python_worker(spark, docs, capsys):
    texts = line_dedup._texts(docs, "text", "doc_id")
    line_dedup._maybe_repeated(texts, line_dedup.build_index(docs, postings=False)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1  # one behind the other take two workers a task
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(500)]
    rows = spark.createDataFrame([(k,) for k in keys], "key binary").selectExpr("pmod(xxhash64(key), 1 << 20) % 7 as shard").collect()
    assert line_dedup.key_shards(keys, 7).tolist() == [r["shard"] for r in rows]


def test_line_index_is_reversible(docs):
    first, more = docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1")
    run = lambda df, index=None: sorted(tuple(r) for r in line_dedup.dedup_lines(df, index, digest=True).collect())
    index = line_dedup.insert(line_dedup.build_index(first), more)
    assert run(docs, index) == run(docs)
    index = line_dedup.delete(index, more.select("doc_id"))
    assert run(first, index) == run(first)


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    f = line_dedup.CuckooFilter.planned(1000)  # overflows into further tables
    f.insert(keys)
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.contains(keys).all()
    f.delete(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.02
    assert f.contains(rng.integers(0, 2**63, 5000, dtype=np.uint64)).mean() < 0.02


@pytest.mark.parametrize("same", [True, False])
def test_forest_holds_one_row_of_candidates(same):
    """Thousands of short near copies in one block: the memory stays far below that of all pairs, the links are whole."""
    import tracemalloc

    import pandas as pd

    cfg = near_dedup.NearDedupConfig()
    rng = np.random.default_rng(3)
    base, sketcher = rng.integers(0, 2**63, 36, dtype=np.uint64), near_dedup.SetSketch(cfg)
    sets = [np.sort(np.append(base, np.uint64(i))) for i in range(1200)] + [np.sort(rng.integers(0, 2**63, 38, dtype=np.uint64)) for _ in range(5)]
    frame = pd.DataFrame({"rep": range(len(sets)), "n": [len(x) for x in sets], "regs": [sketcher(x).tobytes() for x in sets], "hashes": [x.tobytes() for x in sets]})
    left, right = (frame, frame) if same else (frame[frame["rep"] % 2 == 0], frame[frame["rep"] % 2 == 1])
    tracemalloc.start()
    got = near_dedup._forest(cfg, left, right, same)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == [(i, 0) for i in range(1, 1200)]
    assert peak < 20e6


def test_groups_are_cut_by_rows(spark, monkeypatch):
    seen = spark.createDataFrame([(0, i, 10, b"", b"") for i in range(51)], "grp long, rep long, n long, regs binary, hashes binary")
    monkeypatch.setattr(near_dedup, "_forest", lambda cfg, left, right, same, hub=None: [] if hub is not None else [(len(left), len(right))])
    got = [r["a"] for r in near_dedup._within_groups(seen, near_dedup.NearDedupConfig(block_rows=10)).collect()]
    assert len(got) == 15 and max(got) < 25


def test_members_apart_from_the_hub_are_joined(spark):
    """A chain whose end isn't near the hub, a cluster of its own in the same group, and near copies of the hub."""
    cfg = near_dedup.NearDedupConfig(block_rows=4)
    rng = np.random.default_rng(8)
    sketcher, word = near_dedup.SetSketch(cfg), lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    base, far = word(100), word(100)
    sets = {0: base} | {i: np.concatenate([base[i:], word(1)]) for i in range(1, 11)}
    near, end = word(8), word(9)
    sets |= {21: np.concatenate([base[8:], near]), 22: np.concatenate([base[17:], near, end])} | {30 + i: np.concatenate([far[:98], word(2)]) for i in range(5)}
    rows = [(0, i, len(x), sketcher(np.sort(x)).tobytes(), np.sort(x).tobytes()) for i, x in sets.items()]
    links = near_dedup._within_groups(spark.createDataFrame(rows, "grp long, rep long, n long, regs binary, hashes binary"), cfg)
    got = {r["node"]: r["component"] for r in near_dedup.connected_components(links).collect()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and near_dedup.linked(cfg, np.sort(sets[i]), np.sort(sets[j])):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert {i: got.get(i, i) for i in sets} == root and set(root.values()) == {0, 30}
    assert not near_dedup.linked(cfg, np.sort(sets[0]), np.sort(sets[22]))
