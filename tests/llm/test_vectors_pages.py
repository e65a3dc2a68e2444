"""Operators on embeddings and pages against brute force."""

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import lattice, topk, urls, warc
from tests.llm.fixtures import as_tuples


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers, rows = rng.normal(size=(12, 16)), []
    for k in range(260):
        v = centers[k % 12] + rng.normal(size=16) * (0.12 if k % 3 else 0.5)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2 if k % 17 else None, "c"))
    rows += [(300, rows[5][1], 1, "c"), (301, rows[5][1], 1, "c"), (302, None, 1, "c"), (303, [], 1, "c"), (304, [0.0] * 16, 1, "c"), (305, [None] + [1.0] * 15, 1, "c"), (306, [float("nan")] + [1.0] * 15, 1, "c"), (350, [1.0, 2.0], 1, "c"), (400, [2.0, 4.0], 1, "c"), (None, rows[5][1], 1, "c"), (308, [float("inf")] * 16, 0, "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").cache()


def sound(e):
    return e and all(x is not None and math.isfinite(x) for x in e)


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 3
    near = lattice.decode(x)
    assert ((2 * near) % 2 == (2 * near[:, :1]) % 2).all() and (near.sum(1) % 2 == 0).all()
    v = lattice.neighbours()
    assert len(v) == 240 and ((v * v).sum(1) == 2).all()
    others = near[:, None] + v
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()


def test_lattice_links_equal_brute_force(vectors):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    ok = [sound(e) and any(e) and label is not None and i is not None for i, e, label in rows]
    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[rows[a][0]] += 1
                    links[rows[b][0]] += 1
                    root[find(rows[a][0])] = find(rows[b][0])
    low = {}
    for i in root:
        if i is not None:
            low[find(i)] = min(low.get(find(i), i), i)
    want = [(i, links[i], low.get(find(i)), low.get(find(i)) == i) for i, _, _ in rows]
    got = as_tuples(lattice.near(vectors), "vec_id", "n_links", "component_id", "kept")
    found, total = sum(min(g[1], links[g[0]]) for g in got), sum(links.values())
    assert all(g[1] <= links[g[0]] for g in got) and found >= 0.99 * total > 0
    if found == total:
        assert got == sorted(want, key=repr)


def test_hot_cells_go_in_blocks(vectors, monkeypatch):
    whole = as_tuples(lattice.near(vectors), "vec_id", "n_links", "component_id", "kept")
    monkeypatch.setattr(lattice, "BLOCK", 3 * 16)
    assert as_tuples(lattice.near(vectors), "vec_id", "n_links", "component_id", "kept") == whole


@pytest.mark.parametrize("block", [1 << 20, 100 * 16])
def test_large_cells_link_like_small_ones(spark, monkeypatch, block):
    rng = np.random.default_rng(12)
    center = rng.normal(size=16)
    x = center + rng.normal(size=(700, 16)) * rng.choice([0.05, 0.4], (700, 1))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    close = unit @ unit.T >= 0.93
    monkeypatch.setattr(lattice, "BLOCK", block)
    docs = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in lattice.near(docs).collect()}
    want = close.sum(1) - 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum()
    monkeypatch.setattr(lattice, "SMALL", 10**6)
    assert {r["vec_id"]: r["n_links"] for r in lattice.near(docs).collect()} == got


def test_long_vectors_link_too(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=5000)
    near = v + rng.normal(size=5000) * 0.01
    rows = [(1, v.tolist(), 0), (2, v.tolist(), 0), (3, near.tolist(), 0), (4, near.tolist(), 1), (5, v[:4096].tolist(), 0), (6, near[:4096].tolist(), 0), (7, rng.normal(size=5000).tolist(), 0)]
    got = as_tuples(lattice.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links", "component_id", "kept")
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_cells_go_on_over_batches_of_mixed_lengths():
    rng = np.random.default_rng(9)
    rows = []
    for cell, w in ((1, 16), (2, 8), (3, 16), (4, 8), (5, 8), (6, 16)):
        v = rng.normal(size=w)
        rows += [(cell, 0, 0, 0, 10 * cell + k, 1, [cell] * lattice.TABLES * (1 + lattice.PROBES), v.tolist()) for k in range(5)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    whole = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(8)], names=["cell", "i", "j", "block", "node", "weight", "cells", "e"])
    for size in (3, 7, 8, 30):
        found = lattice._compare(0.93, lattice.TABLES, lattice.PROBES)(whole.slice(k, size) for k in range(0, len(rows), size))
        assert sorted(tuple(x.values()) for b in found for x in b.to_pylist()) == [(r[4], 4, r[4] // 10 * 10) for r in rows]


def test_top_k_equals_brute_force(vectors):
    rows = [(r["vec_id"], [math.floor(256 * float(x)) for x in r["embedding"]]) for r in vectors.collect() if sound(r["embedding"]) and r["vec_id"] is not None]
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert as_tuples(topk.search(vectors), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_stops_on_proof_and_skips_postings():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(3000, 12)) * 300 * rng.choice([1, 1, 1, 4], (3000, 1)))
    q = np.floor(rng.normal(size=(7, 12)) * 300)
    best = topk.Best(np.arange(7) + 10**6, q, 5)
    for lo in range(0, 3000, 1000):
        best.meet(topk.Block(np.arange(lo, lo + 1000), x[lo : lo + 1000]))
    for k in range(7):
        want = sorted((-int(q[k] @ v), i) for i, v in enumerate(x))[:5]
        assert best.found[k] == want
    assert best.postings < 0.5 * q.shape[0] * (x != 0).sum()


@pytest.mark.parametrize("size", [1e6, 5e7, 1e15, 1e300, 1.7e308])
def test_top_k_takes_components_of_any_size(spark, size):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) * s for x in rng.uniform(-1, 1, 6)]) for k, s in enumerate([size] * 20 + [1.0] * 20 + [-size] * 11)]
    rows += [(60, rows[0][1]), (61, rows[0][1])]
    whole = {k: [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v] for k, v in rows}
    want = []
    for k in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[k], v)), i) for i, v in whole.items() if i != k)[:5]
        want += [(k, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    got = as_tuples(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)), "query_id", "rank", "vec_id", "score")
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    made = [
        "http://a.b.org/x", "https://EXAMPLE.org/es/1", "https://www.example.org/en/17?q=/no", "http://x.com/fr/a#t", "http://x.com/de/", "http://org", "http://morg/x", "ftp://q.net/a/b/c?x=1&y=2", None, "", "no scheme/org/", "http://x.com/fr", "http://com/de/?",
        "http://a.org?x=/", "://", "http://x.org//", "http://u@h.org:80/\nline", "http://é.org/ü",
    ] * 3
    html = [None, "", "<p>same</p>", "<p>é</p>", "big" * 50000]
    rows = [(k, u, html[k % 5] if k % 7 else f"own {k}", "c") for k, u in enumerate(made)] + [(3, "http://dup.org/", "<p>é</p>", "c"), (None, "http://null.org/", "<p>same</p>", "c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string").cache()


@pytest.mark.parametrize("in_line", [100, 0])
def test_rules_equal_brute_force(pages, monkeypatch, in_line):
    monkeypatch.setattr(urls, "IN_LINE", in_line)
    for r in urls.judge(pages).collect():
        url = r["row"]["url"] or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(rule), rule, v) for rule, v in urls.RULES if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == max(fit)[2] if fit else r["verdict"] in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rows = [(k, f"http://h{k % 7}.net/" + ("1234567" * 3 if k % 2 else "page/read/about"), "") for k in range(300)]
    rules = (*[(f"h{k}.net/1", "block") for k in range(4)], *[(f"h{k}.net/p", "allow") for k in range(4)])
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    unruled = [r for r in found if r["rule"] is None]
    assert unruled and all((r["verdict"] == "block") == (r["row"]["page_id"] % 2 == 1) for r in unruled)


def test_warc_round_trip(spark, pages):
    directory, folder = warc.archive(pages)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    last = {}
    for i, b in rows:
        last[b] = max(last.get(b, -1), -1 if i is None else i)
    want = []
    for i, b in rows:
        first = (-1 if i is None else i) == last[b]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[b]))
    assert as_tuples(warc.read(pages, directory, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    hit = warc.lookup(directory, folder, ["http://a.b.org/x", "http://nowhere.org/"]).collect()
    assert sorted(r["page_id"] for r in hit) == [0, 18, 36]


def test_requests_find_their_own_captures_only(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "CELLS", 3)
    directory, folder = warc.archive(pages)
    assert directory.count() > 12
    some = pages.where("page_id % 5 = 2 OR page_id IS NULL")
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = [r for r in as_tuples(warc.read(pages, directory, folder), *cols)]
    assert len(whole) == pages.count()
    assert as_tuples(warc.read(some, directory, folder), *cols) == [r for r in whole if r[0] is None or r[0] % 5 == 2]
    nowhere = spark.createDataFrame([(2, "http://a.b.org/y"), (999, "http://a.b.org/x"), (None, "http://zzz.zz/")], "page_id long, url string")
    assert warc.read(nowhere, directory, folder).count() == 0


def test_payloads_that_are_no_text(spark):
    raw = [b"\xff\xfe\x00ab", b"\xc3", b"ok", b"\xc3"]
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", bytearray(x)) for k, x in enumerate(raw)], "page_id long, url string, html binary")
    found = {r["page_id"]: r for r in warc.read(pages, *warc.archive(pages)).collect()}
    assert all(found[k]["payload_bytes"] == len(x) and found[k]["payload_digest"] == base64.b32encode(hashlib.sha1(x).digest()).decode() for k, x in enumerate(raw))
    assert found[1]["refers_to"] == 3 and found[3]["record_type"] == "response"


def test_small_payloads_are_no_revisits(spark, pages):
    directory, folder = warc.archive(pages, least=20)
    for r in warc.read(pages, directory, folder).collect():
        assert r["payload_bytes"] >= 20 or r["record_type"] == "response"


def test_empty_tables(spark, vectors, pages):
    v, p = vectors.limit(0), pages.limit(0)
    assert lattice.near(v).count() == topk.search(v).count() == urls.judge(p).count() == warc.read(p, *warc.archive(p)).count() == 0
