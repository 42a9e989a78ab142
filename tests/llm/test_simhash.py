import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components
from tests.llm.helpers import ODD, empty, odd


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """prints: (id, fingerprint). By all pairs."""
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in prints}


def got(df):
    return {(r.doc_id, r.fp % 2**64): r.component_id for r in df.collect()}


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_classes([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert got(simhash.classes(docs)) == want
    assert len(set(want.values())) < len(want)


def test_odd_rows_and_empty(spark):
    want = brute_classes([(r[0], brute_print(r[1])) for r in ODD])
    out = simhash.classes(odd(spark))
    assert got(out) == want and out.count() == len(ODD)
    assert simhash.classes(empty(spark)).count() == 0
    assert simhash.representatives(empty(spark)).count() == 0
    kept = simhash.representatives(odd(spark))
    assert kept.columns == odd(spark).columns
    order = sorted(range(len(ODD)), key=lambda i: (ODD[i][0] is None, ODD[i][0] or 0))
    first = brute_similar([ODD[i][1] for i in order])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(-1 if ODD[order[i]][0] is None else ODD[order[i]][0] for i in set(first))


@pytest.mark.parametrize("page", [8, 1024])
def test_forest_links_are_those_of_all_pairs(spark, monkeypatch, page):
    """Random fingerprints with planted neighbours at 0 to 5 bits, over many small shards."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "SAMPLE_RATE", 1)
    monkeypatch.setattr(simhash, "PAGE", page)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = []
    for x in base[:400]:
        for _ in range(3):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            near.append(int(x) ^ sum(1 << int(b) for b in bits))
    prints = sorted({*map(int, base), *near, 0, 1, 3, 7, 15, 31, 2**64 - 1})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    from plumbline.llm.common import written

    roots = {r.node % 2**64: r.root for r in components(simhash.links(written(df, "t"))).collect()}
    label = {x: roots.get(x, int(np.uint64(x).astype(np.int64))) for x in prints}
    want = brute_classes(list(zip(range(len(prints)), prints)))
    by_got, by_want = {}, {}
    for i, x in enumerate(prints):
        by_got.setdefault(label[x], set()).add(x)
        by_want.setdefault(want[(i, x)], set()).add(x)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_routing_never_loses_a_pair():
    rng = np.random.default_rng(2)
    pts = rng.integers(0, 2**32, 3000, dtype=np.uint64)
    tree = simhash.VantageTree(pts, 50, 1)
    rows, shard, home = tree.route(pts)
    assert tree.shards > 20 and home.sum() == len(pts)
    flip = pts ^ np.uint64(1 << 7)
    r2, s2, h2 = tree.route(flip)
    for i in range(len(pts)):
        a = {(s, h) for s, h in zip(shard[rows == i], home[rows == i])}
        b = {(s, h) for s, h in zip(s2[r2 == i], h2[r2 == i])}
        ha, hb = next(s for s, h in a if h), next(s for s, h in b if h)
        assert hb in {s for s, _ in a} or ha in {s for s, _ in b}


@pytest.mark.parametrize("tree", [0, 1])
def test_equal_halves_are_divided_by_the_other_half(monkeypatch, tree):
    """Fingerprints that agree in all bits of a tree are told apart by their other bits, not all compared."""
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**32, 20_000, dtype=np.uint64)) << np.uint64(32 * (1 - tree))
    fps = np.concatenate((fps, fps[:50] ^ np.uint64(5 << 32 * (1 - tree))))
    compared, scan = [], simhash._scan

    def counted(f, home, visit, radius, measure):
        compared.append(len(home) * (len(home) + len(visit)))
        return scan(f, home, visit, radius, measure)

    monkeypatch.setattr(simhash, "_scan", counted)
    root = simhash.connect(len(fps), simhash.close_pairs(fps, simhash.half(fps, tree), np.ones(len(fps), bool), 1, 3))
    assert sum(compared) < len(fps) ** 2 and all(root[i] == root[len(fps) - 50 + i] for i in range(50))


def test_components_of_a_path_and_a_star(spark):
    """Null ends join nothing."""
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(path + star + [(5, 5), (70, 69), (None, 3), (4, None)], "a long, b long")
    out = {r.node: r.root for r in components(df).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)} | {70: 69}


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_similar(texts, least=0.8):
    """The classes of texts by all pairs: for each text the number of the first that it is joined to."""
    sets, root = brute_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both and both >= least * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(words, n, rng, tag):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"{tag}e{i}"
    return " ".join(out)


@pytest.mark.parametrize("most", [4096, 40])
def test_near_copies_of_five_words_and_08(spark, monkeypatch, most):
    """Copies with few and with many edits, a large group of near copies, and a passage
    that many texts share: recall and precision against all pairs. Also with shards in parts."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(9)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    texts = []
    for k in range(60):
        body = prose(200)
        texts += [" ".join(body), edited(body, 3, rng, f"a{k}"), edited(body, 9, rng, f"b{k}")]
    body, shared = prose(150), prose(80)
    texts += [edited(body, 1, rng, f"c{i}") for i in range(150)]
    texts += [" ".join(prose(100) + shared + prose(100)) for _ in range(80)]
    want = brute_similar(texts)
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first = set(want)
    assert first <= kept, "a text without a similar one before it stays"
    assert len(kept - first) <= 0.02 * (len(texts) - len(first)) and len(first) < 260


@pytest.mark.parametrize("most", [4096, 8])
def test_split_shards_lose_no_pair(spark, monkeypatch, most):
    """Chains whose ends are not alike, and a shard of near copies, in parts of a few sets:
    what one shard finds, its parts find too, also between documents that lead no class."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 9000, 400)]
    texts, step = [], list(words)
    for k in range(60):  # each alike to the next ones only
        for i in rng.choice(400, 5, replace=False):
            step[i] = f"k{k}x{i}"
        texts.append(" ".join(step))
    body = [f"v{i}" for i in rng.integers(0, 9000, 300)]
    texts += [edited(body, 2, rng, f"c{i}") for i in range(40)]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string")
    # One key for all, so that the shard is as large as it can be.
    monkeypatch.setattr(simhash, "min_keys", lambda found: [1])
    want = {(0, texts[0]), (60, texts[60])}
    assert len(set(brute_similar(texts))) == 2
    assert {(r.doc_id, r.text) for r in simhash.representatives(docs).collect()} == want


def test_unlike_sets_of_one_key_end(spark, monkeypatch):
    """More sets than a part holds, none alike: every part meets every other, and nothing is joined."""
    monkeypatch.setattr(simhash, "MOST", 10)
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 9000, 30))) for i in range(45)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "min_keys", lambda found: [1])
    assert simhash.representatives(docs).count() == 45


def test_near_copies_of_documents_match_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[i][0] for i in brute_similar([t for _, t in rows])}
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want


def test_one_text_of_each_class_stays_whatever_the_ids(spark):
    """Null ids, and ids that repeat in other classes: each class keeps one text, and none keeps two."""
    def prose(k):
        return " ".join(f"w{k * 7919 % 1009}x{i * (k + 3) % 997}" for i in range(300))

    rows = [(None, prose(k)) for k in range(20)] + [(None, prose(3)), (3, prose(50)), (5, prose(50).upper()), (5, prose(51)), (9, prose(51)), (9, prose(52)), (9, prose(53))]
    rows += [(9, prose(53)), (None, prose(52)), (None, prose(54)), (7, prose(54)), (7, prose(54))]
    assert len(set(brute_similar([t for _, t in rows]))) == 25
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(None, prose(k)) for k in range(20)} | {(3, prose(50)), (5, prose(51)), (9, prose(52)), (9, prose(53)), (7, prose(54))}
    assert {(r.doc_id, r.text) for r in kept} == want
