"""Operator 4 against all pairs, and the pipeline against its stages run by hand."""

import random
from collections import Counter, defaultdict

import numpy as np

from lumispec.llm import jaccard

SF = "/root/testdata/sf0.01"


def brute(rows):
    """rows: (doc_id, text) -> counter of (doc_id, class_id, copy_id, n_links)."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    copy = {}
    for (d, _), s in zip(rows, sets):
        if d is not None:
            copy[s] = min(copy.get(s, d), d)
    has = list(copy)
    by = defaultdict(list)
    for k, s in enumerate(has):
        for x in s:
            by[x].append(k)
    common = Counter()
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    root, links = list(range(len(has))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in common.items():
        if n / (len(has[a]) + len(has[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(has):
        r = find(k)
        least[r] = min(least.get(r, copy[s]), copy[s])
    number = {s: k for k, s in enumerate(has)}
    out = Counter()
    for (d, _), s in zip(rows, sets):
        k = number.get(s)
        out[(d, None, None, 0) if k is None else (d, least[find(k)], copy[s], links[k])] += 1
    return out


def test_depth():
    d = jaccard.depth()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(tuple(r) for r in jaccard.join(docs).select("doc_id", "class_id", "copy_id", "n_links").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def near_group(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_odd_rows_and_blocks(spark, monkeypatch):
    """Groups over several blocks, copies, short and empty texts, null and repeated ids."""
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    rows = list(enumerate(near_group(150, 1) + near_group(40, 2) + ["", " \n", None, "a", "a", "a b c d", "a b  c d", "a b c d e"]))
    rows += [(None, "a"), (None, "only here w1 w2 w3 w4"), (3, rows[3][1]), (3, "same id other text of this one"), (900, rows[0][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = Counter(tuple(r) for r in jaccard.join(df).collect())
    assert got == brute(rows)
    assert jaccard.join(df.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(0)
    arrays = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in arrays] for a in arrays]
    got = jaccard.shared(arrays)
    for a in range(9):
        for b in range(9):
            if a != b:
                assert got[a, b] == want[a][b]


def test_pipeline(spark):
    import corpus_pipeline
    from lumispec.llm import packing, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.cleaned for r in quality.judge(docs.select("doc_id", "text"), only_kept=True).collect()}
    classes = brute(list(kept.items()))
    stay = {d for d, c, _, _ in classes if d == c}
    assert 0 < len(stay) < len(kept) < docs.count()
    after = spark.createDataFrame([(d, kept[d]) for d in sorted(stay)], "doc_id long, text string")
    clean = pii.sanitise(after).select("doc_id", "sanitised").collect()
    assert all("@mail" not in r.sanitised for r in clean)
    cut = packing.stage(spark, spark.createDataFrame([(r.doc_id, r.sanitised) for r in clean], "doc_id long, text string"), SF)
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF)
    assert Counter(got.select(*cols).collect()) == Counter(cut.select(*cols).collect())
    assert got.select("sequence_id").distinct().count() == cut.select("sequence_id").distinct().count()
