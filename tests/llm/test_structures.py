"""Neighbour graphs, Merkle versions and prefix tries: edge rows against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, merkle, trie
from tidemark.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- HNSW ---------------------------------------------------------------------------------------------------

def brute(rows, k=20, every=20):
    sound = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    sound = [(i, np.array(v)) for i, v in {(i, tuple(v)) for i, v in sound}]
    out = []
    for i, q in sound:
        if i is not None and i % every == 0:
            hits = sorted((-float((q * v).sum()), j is None, j or 0) for j, v in sound if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, None if gone else j, round(-s, 9)) for n, (s, gone, j) in enumerate(hits)]
    return sorted(out, key=repr)


def test_neighbours_of_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 160)]
    rows += [(0, rows[0][1]), (None, [1.0, 0.0, 0.0, 0.0]), (200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [float("nan"), 1.0, 1.0, 1.0]),
             (300, [float("inf"), 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [5.0] * 3), (20, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, node int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in hnsw.nearest_neighbours(df).collect()), key=repr)
    assert got == brute(rows)
    assert hnsw.nearest_neighbours(df.limit(0)).count() == 0


def clumps(rng, n=6000, d=24):
    """A third of the vectors lie in one tiny ball, a tenth are far longer than the others."""
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.01 * rng.normal(size=(n // 3, d))
    x[-n // 10:] *= 5
    return x[rng.permutation(n)]


def test_recall_on_hard_vectors(spark):
    x = clumps(np.random.default_rng(2)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::20] @ x.T
    scores[np.arange(len(scores)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    recall = np.mean([len(got[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    assert recall >= 0.9, recall


def test_recall_and_order_over_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 30)
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    vectors = hnsw.store(hnsw.usable(df), "vectors")
    found = hnsw.index(vectors)
    assert found.select("shard").distinct().count() == 3 and found.agg(F.sum(F.size("ids"))).first()[0] == len(rows)
    out = hnsw.search(found, vectors.where("vec_id % 20 = 0")).collect()
    want = {(q, j) for q, _, j, _ in brute(rows)}
    assert len({(r.query_id, r.vec_id) for r in out} & want) >= 0.9 * len(want)
    x = {i: np.array(v, float) for i, v in rows}
    for r in out:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    per = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        per.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) == 20 for v in per.values())


def test_graph_is_kept_as_flat_arrays():
    x = np.random.default_rng(3).normal(size=(500, 8))
    a, b = hnsw.build(x), hnsw.build(x)
    assert all((p == q).all() for p, q in zip(a.links, b.links, strict=True))
    for layer, links in enumerate(a.links):
        assert links.shape == (500, hnsw.LINKS * (2 if layer == 0 else 1)) and links.max() < 500
        assert (links[a.level < layer] == hnsw.NOBODY).all()
        used = links[links >= 0]
        assert (a.level[used] >= layer).all()


# --- Merkle -------------------------------------------------------------------------------------------------

def fold_up(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def siblings(levels, pos):
    out = []
    for nodes in levels[:-1]:
        first = pos // 16 * 16
        out.append((nodes[first:pos], nodes[pos + 1:first + 16]))
        pos //= 16
    return out


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return None if text is None else text.translate({i: i + 32 for i in range(65, 91)})


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = fold_up([leaf(r) for r in by[s]])
    top = fold_up([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for pos, r in enumerate(by[s]):
            path = siblings(trees[s], pos) + siblings(top, at)
            now = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for before, after in path:
                now = sha("".join([*before, now, *after]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(x for a, b in path for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=repr)


DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf int, pos int, block string"


def manifests(n, hosts, seed=0):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, i // 2]), rng.choice(hosts), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Mixed Été", "all low", "", None, "ABC " * 5000])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(7, "only", "en", 3, "Abc")], manifests(40, [None, "", "a", "B", "é", "b"]), manifests(900, ["hot"] * 20 + [f"h{i}" for i in range(30)], 1),
    manifests(700, ["one"], 2), [(None, None, None, None, None)] * 20 + [(3, "x", "en", 1, "SAME")] * 18, manifests(300, [f"h{i}" for i in range(290)], 3)])
def test_manifest(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOC)
    got = merkle.tamper_report(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_empty(spark):
    assert merkle.tamper_report(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256])
def test_versions_share_nodes(n):
    own = [sha(str(i)) for i in range(n)]
    levels = merkle.height(n)
    tree = merkle.grow(own, levels)
    assert tree.digest == fold_up(own)[-1][0]
    version = merkle.replaced(tree, n // 2, levels, sha("new"))
    assert version.digest == fold_up([*own[: n // 2], sha("new"), *own[n // 2 + 1:]])[-1][0]
    kept = {id(k) for k in walk(tree)}
    assert sum(id(k) not in kept for k in walk(version)) == levels + 1  # the leaf and its ancestors only


def walk(node):
    yield node
    for k in node.kids:
        yield from walk(k)


def test_copied_ancestors_and_siblings(spark):
    leaves = [(i, "s" if i < 300 else "t", sha(str(i)), sha(f"new{i}") if i % 50 == 0 else None) for i in range(310)]
    out = merkle.manifest(spark.createDataFrame(leaves, "id long, source string, leaf string, changed string"), siblings=True).collect()
    trees = {s: fold_up([x[2] for x in leaves if x[1] == s]) for s in "st"}
    top = fold_up([trees["s"][-1][0], trees["t"][-1][0]])
    for r in out:
        pos = r.id if r.source == "s" else r.id - 300
        path = siblings(trees[r.source], pos) + siblings(top, 0 if r.source == "s" else 1)
        assert r.siblings == [x for a, b in path for x in a + b] and r.folded[-1] == top[-1][0] and r.folded[-2] == r.subroot
        assert (r.copied is None) == (r.changed is None)
        now = r.changed
        for (before, after), got in zip(path, r.copied or [], strict=r.changed is not None):
            now = sha("".join([*before, now, *after]))
            assert got == now


# --- prefix trie --------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        own.setdefault(c, []).append(((t is not None, t or 0), r, sha(f"{len(r.encode())}:{r}{x}"), x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        whole[c] = v if c is None else own.get(c - int(np.fmod(c, 5)), [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    out = []
    for k, v in members.items():
        below = [n for n in members if n[:len(k)] == k]
        kids = [n for n in below if len(n) == len(k) + 1]
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) > len(n) for m in members)]
        ends = sorted((c for c in v if len(whole[c]) == len(k)), key=lambda c: (c is not None, c or 0))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), len(kids), len(leaves), saved, sha(",".join("" if c is None else str(c) for c in ends))))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string, n int, depth string"


def talks(n, seed, words=2, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ("user", "assistant")[t % 2], rng.choice([f"é{rng.randrange(words)}", "", None])))
    return rows


EDGE = [(None, 0, "user", "hello"), (None, 1, "assistant", "x"), (10, 0, "user", "hello"), (15, 0, "user", "hello"), (15, 1, "assistant", "x" * 70_000), (13, 0, "user", "hello"), (-7, 0, "user", "hello"), (-7, 1, None, None),
        (21, 0, "a", "b"), (21, 0, "a", "b"), (23, None, "a", "b"), (25, None, None, None)]


@pytest.mark.parametrize("rows", [talks(60, 1), talks(40, 2, 1, 4), talks(50, 3, 50), EDGE, [(4, 0, "user", "q")], talks(200, 4, 1, 2) + talks(1, 5, 1, 12)])
def test_trie(spark, rows):
    got = trie.trie(spark.createDataFrame([(*r, 9, "x") for r in rows], CONV)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


def test_trie_with_a_full_sketch(spark, monkeypatch):
    """A sketch far too small proves little; the result is the same."""
    rows = talks(60, 7, 3)
    monkeypatch.setattr(trie, "MIN_BITS", 3)
    monkeypatch.setattr(trie, "MAX_BITS", 3)
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    monkeypatch.setattr(trie, "ID_CHUNK", 2)
    got = trie.trie(spark.createDataFrame([(*r, 9, "x") for r in rows], CONV)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


def test_screen_never_calls_a_shared_prefix_alone(spark):
    rows = talks(300, 8, 2)
    convs, rebuilt = trie.rebuild(spark.createDataFrame([(*r, 9, "x") for r in rows], CONV))
    screened = trie.screen(trie.prefixes(convs, rebuilt))
    counts = screened.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n"), F.max("local").alias("local"))
    assert counts.where("n > 1 and local").count() == 0
    assert counts.where("n = 1 and local").count() > 0.9 * counts.where("n = 1").count() > 0


def test_trie_empty(spark):
    assert trie.trie(spark.createDataFrame([], CONV)).count() == 0
