"""Vector codes, fill-in-middle and URL filters against plain Python and their SQL."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from kairolake.llm import fim, url_filter, vector_codes

TABLES = {"op11": "embeddings", "op12": "documents", "op13": "pages"}


@pytest.mark.parametrize("op", TABLES)
def test_sql(spark, sf_dir, op):
    name = next(k for k in __spark_entry__.queries() if k.startswith(op + "_"))
    con = duckdb.connect()
    con.execute(f"create view {TABLES[op]} as select * from '{sf_dir}/{TABLES[op]}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(df.columns))
    known = lambda rows: sorted(map(tuple, rows), key=str)
    assert known(df.select(*sorted(df.columns)).collect()) == known(con.execute(f"select {columns} from ({__spark_entry__.oracle_sql()[name]})").fetchall())


# vector codes


def lloyd(vectors: dict, parts: int, entries: int, rounds: int):
    """Plain rounds over (id -> integer components)."""
    ids = sorted(vectors)
    bounds = vector_codes.part_bounds(len(vectors[ids[0]]), parts)
    cut = lambda i, k: vectors[i][bounds[k] : bounds[k + 1]]
    books = [[list(cut(i, k)) for i in ids[:entries]] for k in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            of = {}
            for i in ids:
                of.setdefault(nearest(cut(i, k), book)[1], []).append(cut(i, k))
            for j, rows in of.items():
                book[j] = [sum(c) // len(rows) for c in zip(*rows, strict=True)]
    out = {}
    for i in ids:
        found = [nearest(cut(i, k), books[k]) for k in range(parts)]
        out[i] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, id string, key string, n int, code int, sums double"


def vector_rows(rng, n, dim, spread):
    centres = rng.normal(size=(7, dim))
    x = (centres[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    x[n // 2 : n // 2 + 20] = x[3]  # equal vectors: ties
    return [(i, x[i].tolist(), [None, 0, 1, 1][i % 4], "a", "b", 1, 2, 3.0) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0005, 0.02, 1.0])
def test_vector_codes(spark, spread, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 4 * 10 * 150)  # several blocks a task
    rows = vector_rows(np.random.default_rng(3), 400, 10, spread)
    codes, books = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=40)
    want, want_books = lloyd({r[0]: [math.floor(1024 * x) for x in r[1]] for r in rows}, 4, 40, 4)
    got = {r["vec_id"]: r for r in codes.collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == want and [b.tolist() for b in books] == want_books
    of = {}
    for i, _, label, *_ in rows:
        of[label] = of.get(label, 0) + want[i][1]
    assert all(got[i]["label_error"] == of[label] for i, _, label, *_ in rows)
    assert vector_codes.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_dual_tree_prunes_and_assigns_nodes():
    """Tight clusters: whole nodes are assigned, few rows are compared, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (64, 8))
    points = (np.repeat(centres, 64, axis=0) + rng.integers(-2, 3, (4096, 8))).astype(np.int64)
    tree, entries = vector_codes.tree_over(points, vector_codes.LEAF), vector_codes.tree_over(centres, vector_codes.ENTRY_LEAF)
    found = vector_codes.dual_tree(tree, points[tree.order], entries, centres)
    entry, d = vector_codes._codes(tree, points[tree.order], found, centres)
    assert (entry == np.repeat(np.arange(64), 64)).all() and (d == ((points - centres[entry]) ** 2).sum(1)).all()
    assert tree.counts[found.nodes].sum() > 2048 and found.pairs < 4096 * 64 / 20
    sums, counts = vector_codes._totals(tree, points[tree.order], found, 64)
    assert (counts == 64).all() and (sums == points.reshape(64, 64, 8).sum(1)).all()


def test_exact_distances_beyond_doubles():
    top = vector_codes.limit(4)
    points, entries = np.array([[top, -top, top - 1, 7]]), np.array([[-top, top, 1 - top, 6], [top, -top, top - 1, 8]])
    tree = vector_codes.tree_over(points, 16)
    d = vector_codes._exact(points, (points**2).sum(1), entries)
    assert d.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(points[0], e, strict=True)) for e in entries]] and tree.counts[1] == 1


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.25, 1e30, 0.0, 3.0, 1.0], 1), (None, [0.5, 0.25, 0.0, 0.0, 3.0, 1.0], None), (2, None, 1), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
            (6, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (7, [], 1), (8, [1.0, 2.0], 1), (5, [0.5, -0.25, 1e30, 0.0, 3.0, 1.0], 1), (9, [0.5, 0.2, -1e30, 0.0, 3.0, 1.0], None)]
    codes, books = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"]) for r in codes.collect())
    assert [g[0] for g in got] == [-1, 5, 5, 9] and len(books) == 4 and [b.shape for b in books] == [(4, 2), (4, 2), (4, 1), (4, 1)]
    assert got[1] == got[2] and all(g[2] == 0 for g in got)  # every row is an entry of its own; of equal ones the lower index
    none, books = vector_codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.columns == ["vec_id", "code", "error", "label_error"] and none.count() == 0 and books == []
    bare, _ = vector_codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in bare.collect()] == [(1, "00000000", 0, 0)]


# fill-in-middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = np.random.default_rng(1)
    pieces = ["a", "ß", "語", "😀", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\xa0", "\x1f", "!", "<P", "<", ">", "\x00", "word", "\u2028"]
    own = ["", None, " ", "   ", "x", " x", "x ", "<P>a b c", "a <S", "é" * 9, "\u0889\u0920 \u200d", "ab cd ef gh " * 30000]
    return own + ["".join(rng.choice(pieces, int(rng.integers(1, 40)))) for _ in range(600)]


def test_fill_in_middle(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "x", 3) for i, t in enumerate(texts())] + [(None, "no id here at all", "x", 1), (700, "twice the id", "y", 1), (700, "twice the id", "y", 1)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3))
    got = sorted((tuple(r) for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()), key=str)
    assert got == sorted(((i, *middle(i, t), t or "") for i, t, *_ in rows), key=str)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_marks():
    """Rank and select over words against a list of places."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4096).astype(np.uint8)
    want = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    marks = fim.Marks(fim.white_marks(data.view("<u8")))
    assert (marks.place(np.arange(1, len(want) + 1)) == want).all()
    assert (marks.before(np.arange(4096)) == np.searchsorted(want, np.arange(4096))).all()


def test_fill_in_middle_edges(spark, edge, empty):
    assert fim.fill_in_middle(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and fim.fill_in_middle(empty).count() == 0
    assert sorted(map(tuple, fim.fill_in_middle(edge).collect()), key=str) == sorted(((r["doc_id"], *middle(r["doc_id"], r["text"])) for r in edge.collect()), key=str)
    with pytest.raises(ValueError):
        fim.fill_in_middle(edge, sentinels=("aba", "bac", "x"))


# URL filters


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def written(host, path, rules):
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def digamma(x):
    return sum(-1 / (x + i) for i in range(2000)) + math.log(x + 2000) - 1 / (2 * (x + 2000))


def trigamma(x):
    return sum(1 / (x + i) ** 2 for i in range(20000)) + 1 / (x + 20000) + 1 / (2 * (x + 20000) ** 2)


def reputation(outcomes, names):
    """(low, share) by host; outcomes: host -> (bad, labelled); names: host -> (suffix, domain)."""
    sums = [{}, {}, {}]
    for h, (k, n) in outcomes.items():
        for level, key in zip(sums, (*names(h), h), strict=True):
            level[key] = [a + b for a, b in zip(level.get(key, (0, 0)), (k, n), strict=True)]
    k, n = (sum(x[i] for x in outcomes.values()) for i in (0, 1))
    prior = {key: (k + 1) / (n + 2) for key in sums[0]}
    for i, level in enumerate(sums):
        if i:
            up = {key: names(h)[i - 1] for h in outcomes for key in ((*names(h), h)[i],)}
            prior = {key: mean[up[key]] for key in level}
        seen = [(k, n, prior[key]) for key, (k, n) in level.items() if n]
        spread, rows = sum((k - n * m) ** 2 / (n * m * (1 - m)) for k, n, m in seen), sum(n for _, n, _ in seen)
        rho = min(max((spread - len(seen)) / (rows - len(seen)) if rows > len(seen) else 0.95, 0.001), 0.95)
        s = 1 / rho - 1
        mean = {key: (k + s * prior[key]) / (n + s) for key, (k, n) in level.items()}
    out = {}
    for h, (k, n) in sums[2].items():
        a, b = k + s * prior[h], n - k + s * (1 - prior[h])
        out[h] = 1 / (1 + math.exp(-(digamma(a) - digamma(b) - 1.645 * math.sqrt(trigamma(a) + trigamma(b))))), a / (a + b)
    return out


def last_names(host):
    return host.split(".")[-1], ".".join(host.split(".")[-2:])


URLS = ["http://A.Example.ORG/es/1?x=/fr/", "https://example.org/en/1abc", "https://notexample.org/en/1", "ftp://example.org", "https://example.org?/es/", "http://com/fr/", "http://x.com/de", "http://x.com/de/", "x.com/de/1", None, "", "://", "a://b://c.org/x", "http://u@h.com:80/de/1", "http://x.com#/de/", "http://org/", "http://é.COM/de/É"] + [f"http://long.com/{'p' * 50000}"]


def test_rules(spark):
    rules = [*url_filter.RULES, ("x.com", "/de", "allow"), ("com", "/de/", "allow"), ("h.com:80", "/", "block"), ("c.org", "", "block")]
    rows = [(i % 15, u, "h", 1, "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", 1, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, n int, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((p, *parts(u), *written(*parts(u), rules)) for p, u, *_ in rows), key=str)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark).limit(0)).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_reputation(spark):
    rng = np.random.default_rng(4)
    outcomes = {f"h{i}.d{i % 5}.{'net' if i % 2 else 'org'}": (int(k := rng.binomial(n := int(rng.integers(1, 40)), [0.05, 0.9, 0.3, 0.5, 0.1][i % 5])), n) for i in range(60)} | {f"new.d{i}.net": (0, 0) for i in range(6)}
    got = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame([(h, k, n) for h, (k, n) in outcomes.items()], "host string, bad long, labelled long")).collect()}
    want = reputation(outcomes, last_names)
    assert got.keys() == want.keys()
    for h, (low, share) in want.items():
        assert got[h]["low"] == pytest.approx(low, abs=1e-4) and got[h]["share"] == pytest.approx(share, abs=1e-9) and got[h]["low"] < share < got[h]["high"]
    # the hosts' priors: a host without labels follows its domain
    assert got["new.d1.net"]["share"] > 0.7 > 0.3 > got["new.d0.net"]["share"] and got["new.d1.net"]["low"] < got["h1.d1.net"]["share"]


def test_op13_by_hand(spark, sf_dir):
    """The registered query over the whole table: rules, counted outcomes, bounds."""
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    judged = {p: (*parts(u), *written(*parts(u), url_filter.RULES)) for p, u in pages}
    outcomes = {}
    for host, _, rule, verdict in judged.values():
        k, n = outcomes.get(host, (0, 0))
        outcomes[host] = (k + (verdict == "block"), n + (rule is not None))
    low = reputation(outcomes, last_names)
    want = {p: (h, path, rule, verdict or ("block" if low[h][0] >= 0.5 else "allow")) for p, (h, path, rule, verdict) in judged.items()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in __spark_entry__.queries()["op13_url_filter"](spark, sf_dir).collect()}
    assert got == want


def test_suffix_and_domain(spark):
    from pyspark.sql import functions as F

    hosts = ["a.b.co.uk", "co.uk", "b.com", "com", "", "x.y.z.net:80", "u@a.b.org", "10.0.0.1:81", "a.co.de.", "[::1]"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select(*url_filter.suffix_and_domain(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "b.com"), ("com", "com"), ("", ""), ("net", "z.net"), ("org", "b.org"), ("10.0.0.1", "10.0.0.1"), ("co.de.", "a.co.de."), ("[::1]", "[::1]")]


def test_labelled_pages_decide(spark):
    """Bad hosts are blocked by the labels of other pages, also a few bad pages don't block a good one."""
    pages = [(i, f"http://{h}/p{i}") for i, h in enumerate(["bad.shop.net", "good.net", "few.net", "unknown.org"] * 5)]
    outcomes = [("http://bad.shop.net/1", 1)] * 40 + [("http://good.net/1", 0)] * 40 + [("http://few.net/1", 1)] * 2 + [("http://few.net/1", 0)] * 3 + [(None, 1), ("http://good.net/1", None)]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), url_filter.rule_table(spark), spark.createDataFrame(outcomes, "url string, bad int"))
    verdicts = {(r["host"], r["verdict"]) for r in got.collect()}
    assert verdicts == {("bad.shop.net", "block"), ("good.net", "allow"), ("few.net", "allow"), ("unknown.org", "allow")}
