"""Near copies, repeated passages, near vectors and components against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from gramforge.llm import blocks, jaccard, recompress, vectors
from gramforge.llm.components import components, forest_of
from tests.llm.conftest import AWKWARD


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1300)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == {n: r for n, r in roots({x for p in links for x in p}, links).items() if n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    n, r = forest_of(np.array([3, 5]), np.array([5, 9]))
    assert list(n) == [3, 5, 9] and list(r) == [3, 3, 3]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_rows(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({i for i, _ in sets if i is not None}, links)
    return sorted(((-1 if i is None else i), len(s), -1 if i is None else root[i]) for i, s in sets)


def near_copies(seed, n, words=60, group=6):
    rng = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if i % group == 0:
            base = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(1, words))]
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if own:
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[f"v{rng.randint(0, 3000)}"], [], [own[k], f"v{rng.randint(0, 3000)}"]])
        out.append((i * 7 % 1009, " ".join(own)))
    return out


@pytest.mark.parametrize("rows", [AWKWARD, near_copies(1, 240), near_copies(2, 120, 9, 20), near_copies(3, 90, 300, 45)])
def test_jaccard(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.linked_documents(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == jaccard_rows(rows)


def test_jaccard_chain_and_passage(spark):
    """A chain whose ends don't link, and texts that share one passage and no more."""
    base = [f"a{i}" for i in range(104)]
    chain = [(100 + k, " ".join(base[:104 - 9 * k])) for k in range(6)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = chain + [(200 + k, passage + " " + " ".join(f"q{k}x{i}" for i in range(30))) for k in range(40)]
    got = jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_rows(rows)


def test_jaccard_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "TASK_SETS", 5)
    rows = near_copies(5, 150, 40, 50)
    got = jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_rows(rows)


def link_counts(rows):
    """For each row with an id the number of other rows that it links with."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    n = [0] * len(rows)
    for (a, (i, x)), (b, (j, y)) in combinations(enumerate(sets), 2):
        if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            n[a] += 1
            n[b] += 1
    return sorted((-1 if i is None else i, len(x), k) for (i, x), k in zip(sets, n, strict=True))


def variants(seed, n):
    """Different texts that nearly all link with each other, and a few copies."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(120)] = f"z{i}x{rng.randint(0, 9)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("rows", [AWKWARD, near_copies(1, 240), near_copies(3, 90, 300, 45), variants(1, 130)])
def test_jaccard_whole_join(spark, monkeypatch, rows):
    """Every link is counted, and pairs of sets with their members give the same links."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (512, 16):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got = jaccard.linked_documents(docs).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.n_links) for r in got) == link_counts(rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == jaccard_rows(rows)
    members, pairs = jaccard.links(docs)
    held = {}
    for r in members.collect():
        held.setdefault(r.set, []).append(r.doc_id)
    met = [(r.x, r.y) for r in pairs.collect()]
    assert len(met) == len(set(met)) and all(x < y for x, y in met)
    total = 2 * sum(len(held[x]) * len(held[y]) for x, y in met) + sum(len(h) * (len(h) - 1) for h in held.values())
    assert total == sum(n for _, _, n in link_counts(rows))


def test_jaccard_clashing_names_and_no_rows(awkward, no_documents):
    assert jaccard.linked_documents(awkward).count() == len(AWKWARD)
    assert jaccard.linked_documents(no_documents).count() == 0


def test_prefix_tree_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(60):
        probe = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        members = [np.unique(np.concatenate([probe[rng.random(len(probe)) < rng.choice([0.5, 0.9, 1])], rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(20)]
        members = [m for m in members if len(m)]
        for m, n in zip(members, jaccard.overlaps(probe, members, 80), strict=True):
            both = len(np.intersect1d(m, probe))
            links = 100 * both >= 80 * (len(m) + len(probe) - both)
            assert (n == both) if links else n == -1


def dedup_rows(rows, size=13):
    first = {}
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, float("inf")), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed, n):
    rng = random.Random(seed)
    shared = [[f"s{rng.randint(0, 40)}" for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(8)] + [["la"] * 30, ["a", "b"] * 12, ["x"] * 9 + ["y"] * 9]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 20))]
            p = rng.choice(shared)
            a = rng.randint(0, 3)
            words += p[a : len(p) - rng.randint(0, 3)]
        out.append((rng.randint(0, 10**6), rng.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize("rows", [AWKWARD, passages(1, 150), passages(2, 150)])
def test_recompression(spark, rows):
    got = recompress.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((float("inf") if r.row.doc_id is None else r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == dedup_rows(rows)
    for r in got:
        assert r.kept is not None


def test_recompression_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    rows = passages(3, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # block sizes are set where tasks run, so the small ones are made by the number of partitions
    got = recompress.dedup(docs.repartition(16)).collect()
    assert sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == dedup_rows(rows)


def test_equal_windows_get_equal_keys():
    """Whatever surrounds a window, its key is the same: the ranges that decide symbols are right."""
    rng = np.random.default_rng(7)
    for alphabet in (2, 3, 10, 1000):
        names = rng.integers(1, 1 << 62, alphabet).astype(np.uint64)
        seen = {}
        for _ in range(40):
            w = rng.integers(0, alphabet, 400)
            if alphabet == 3:
                w = np.repeat(w, rng.integers(1, 9, 400))[:400]
            for k, key in enumerate(recompress.window_keys(names[w], 13).tolist()):
                assert seen.setdefault(tuple(w[k : k + 13].tolist()), key) == key


def test_recompression_carries_columns(awkward, no_documents):
    got = recompress.dedup(awkward)
    assert sorted(got.select("row.*").columns) == sorted(c for c in awkward.columns if c != "text")
    assert got.count() == len(AWKWARD)
    assert recompress.dedup(no_documents).count() == 0


def vector_rows(rows, threshold=0.98):
    ok = []
    for i, v, lab in {r[0]: r for r in sorted(rows, key=str) if r[0] is not None}.values():
        if lab is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok.append((i, np.array(v, np.float64), lab))
    links = []
    for (a, x, p), (b, y, q) in combinations(ok, 2):
        if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links.append((a, b))
    return links


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for lab in (0, 1, None):
        for _ in range(30):
            c = rng.standard_normal(16)
            for _ in range(rng.integers(1, 5)):
                rows.append((i, [float(np.float32(z)) for z in c + rng.standard_normal(16) * 0.03], lab))
                i += 1
    c = rng.standard_normal(16)
    rows += [(1000 + k, [float(np.float32(z)) for z in c + rng.standard_normal(16) * 0.04], 1) for k in range(120)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None] + [1.0] * 14, 1), (5004, [], 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [1e-30, 2e-30], 1), (5008, [float("inf")] * 16, 0), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    links = vector_rows(rows)
    n = {k: 0 for k in got}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * 2 * len(links)  # the index may miss some; what it finds is verified
    assert all(got[k].n_links <= n[k] for k in n)
    root = roots([k for k in got if k is not None], links)
    assert np.mean([got[k].component_id == root[k] for k in root]) > 0.97
    assert got[5005].n_links == 2 and got[5007].component_id == 5005 and got[None].component_id is None and not got[None].kept
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.values())


def test_vectors_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links = 0
    for lab in {r[2] for r in rows}:
        x = np.array([r[1] for r in rows if r[2] == lab], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += int((x @ x.T >= 0.98).sum()) - len(x)
    found = sum(r.n_links for r in vectors.near_duplicates(df).collect())
    assert found <= links and found >= 0.9 * links


def test_vectors_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c = rng.standard_normal(8)
    rows = [(k, [float(z) for z in c + rng.standard_normal(8) * 0.01], 1) for k in range(100)]
    monkeypatch.setattr(vectors, "CHUNK", 16)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) == 2 * len(vector_rows(rows)) and {r.component_id for r in got} == {0}


def test_vectors_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1)}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_repeated_ids(spark, monkeypatch):
    """All usable vectors of an id are compared, links with another id count once, and unusable rows hide none."""
    near = lambda x, k: [x, 1.0 - x, 0.001 * k]
    rows = [(1, None, 1), (1, near(1.0, 0), 1), (2, near(1.0, 1), 1), (3, near(0.0, 0), 1), (3, near(1.0, 2), 1), (3, near(1.0, 3), 1), (4, near(0.0, 1), 1), (4, near(0.0, 2), None), (5, [-1.0, 0.0, 0.0], 1), (5, [-1.0, 0.0, 0.001], 1), (None, near(1.0, 0), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for chunk in (1024, 2):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
        assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (3, 1, False), 4: (1, 1, False), 5: (0, 5, True), None: (0, None, False)}


def test_equal_vectors_are_compared_once(spark):
    """Thousands of copies of one vector, and ids with several vectors that others have too, against brute force."""
    rng = np.random.default_rng(4)
    base = [[float(np.float32(z)) for z in c] for c in np.concatenate([rng.standard_normal((6, 4)), [[1, 0, 0, 0], [1, 0.05, 0, 0], [1, 0, -0.0, 0.06]]])]
    rows = [(int(rng.integers(0, 60)), base[int(rng.integers(0, len(base)))], int(rng.integers(0, 2))) for _ in range(150)]
    found = {}
    for a, x, p in rows:
        for b, y, q in rows:
            if a != b and p == q and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.98:
                found.setdefault(a, set()).add(b)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    root = roots(list(got), [(a, b) for a, x in found.items() for b in x])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (len(found.get(i, ())), root[i]) for i in got}
    copies = [(10_000 + k, [1.0, 0.0], 7) for k in range(3000)] + [(9, [1.0, 0.01], 7), (8, [0.0, 1.0], 7)]
    own = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(copies, "vec_id long, embedding array<float>, label int")).collect()}
    assert own == {k: (3000, 9, k == 9) for k in [9, *range(10_000, 13_000)]} | {8: (0, 8, True)}


def test_vectors_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, 6, 7, "x"), (2, [1.0, 0.0], 1, 5, 6, 7, "x")], "vec_id long, embedding array<float>, label int, _k long, component_id long, n_links long, _own string")
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_join_of_texts_that_share_a_passage(spark):
    """Thousands of different texts with one passage in common, which is most of some and not enough of others."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, passage + " " + " ".join(f"q{k}x{i}" for i in range(2 if k % 50 == 0 else 40))) for k in range(3000)]
    got = sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == [(k, 38, 59, 0) if k % 50 == 0 else (k, 76, 0, k) for k in range(3000)]


def test_a_window_in_every_document(spark):
    notice = " ".join(f"n{i}" for i in range(20))
    rows = [(k, f"a{k} b{k} {notice} c{k}") for k in range(3000)]
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in recompress.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: (23, 20 if k else 0) for k in range(3000)}


def test_word_hashes():
    """Equal words have equal hashes wherever they are, others have others; words longer than a part too."""
    rng = random.Random(6)
    texts = [b"", b" \n", b"a", ("é" * 40_000 + " b " + "x" * 200_000 + " " + "x" * 200_001).encode(), " ".join(rng.choice(["ab", "ba", "a", "b", "abab", "\x85", "y" * 1024, "y" * 1025]) for _ in range(60_000)).encode(), b"x" * 200_000]
    h, sizes = blocks.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(words) == len(h)
    named = {}
    for w, k in zip(words, h.tolist(), strict=True):
        assert named.setdefault(w, k) == k
    assert len(set(named.values())) == len(named)
