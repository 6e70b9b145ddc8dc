"""Whole results on planted cases: what lies near the limits of a rule is found too."""

import collections
import itertools
import math
from pathlib import Path

import numpy as np

import corpus_pipeline
from tidefold.llm import common, decontam, lines, nearcopies, simhash


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    """Copies at similarity 0.8 to 0.9 and a large group in blocks go; copies right below 0.8 stay."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{n}" for n in range(5000)])
    docs, want = [], set()
    for n in range(120):
        base = rng.choice(vocabulary, 120).tolist()
        copy = list(base)
        for at in range(10, 10 + 18 * (1 + n % 3), 18):
            copy[at] = "other"
        near = jaccard(" ".join(base), " ".join(copy)) >= 0.8
        docs += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(copy))]
        want |= {10 * n} if near else {10 * n, 10 * n + 1}
    assert 120 < len(want) < 240
    base = rng.choice(vocabulary, 100).tolist()
    docs += [(5000 + n, " ".join([*base[:n], "x", *base[n + 1 :]])) for n in range(100)]
    want.add(5000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want
    assert {r.component_id for r in nearcopies.groups(df, block=16).collect()} == want


def test_near_copies_meet(spark):
    """Texts whose fingerprints meet at an anchor but differ in over three bits aren't brought together; those within three bits are found there."""
    rng = np.random.default_rng(14)
    vocabulary = np.array([f"w{n}" for n in range(5000)])
    texts = [" ".join(rng.choice(vocabulary, 6).tolist()) for _ in range(20000)]
    fps = np.array([simhash.fingerprint(x, nearcopies.WIDTH) for x in texts], np.uint64)
    at = collections.defaultdict(list)
    for half_no in (0, 1):
        for row, bucket, _ in zip(*(x.tolist() for x in simhash.anchors(fps, half_no)), strict=True):
            at[bucket].append(row)
    meet = sorted({r for x in at.values() if len(x) > 1 for r in x if not any(int(fps[r] ^ fps[q]).bit_count() <= 3 for q in x if q != r)})
    assert len(meet) > 500
    docs = [(n, texts[r]) for n, r in enumerate(meet)]
    before = set(Path(common.shared_dir(spark)).glob("near-texts-*"))
    got = nearcopies.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.id, r.component_id) for r in got} == {(n, n) for n, _ in docs}
    (sent,) = set(Path(common.shared_dir(spark)).glob("near-texts-*")) - before
    assert spark.read.parquet(str(sent)).count() < 10
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 40, np.uint64) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 5)] + [fps[:2000] ^ np.uint64(1 << 40), fps[:2000]]))
    want = {(int(x), int(y)) for n, x in enumerate(fps) for y in fps[n + 1 :][np.bitwise_count(fps[n + 1 :] ^ x) <= 3]}
    assert len(want) >= 2000
    classes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "sig long, fp long")
    cells = collections.defaultdict(list)
    for r in nearcopies._at_anchors(classes).collect():
        cells[r.bucket].append(r.sig % (1 << 64))
    assert want <= {tuple(sorted(p)) for x in cells.values() for p in itertools.combinations(x, 2)}
    assert sum(map(len, cells.values())) < 40 * len({x for p in want for x in p})


def test_near_copies_sent_once(spark):
    """Copies of copies, whose bands and anchors divide them in many ways, are sent to one place; larger groups to as few as will do. All links are found."""
    rng = np.random.default_rng(15)
    vocabulary = np.array([f"w{n}" for n in range(5000)])
    docs = []
    for n in range(12):
        family = [rng.choice(vocabulary, 150).tolist()]
        while len(family) < (60 if n == 0 else 10):
            copy = list(family[int(rng.integers(len(family)))])
            for at in rng.integers(0, 150, 2):
                copy[at] = str(rng.choice(vocabulary))
            family.append(copy)
        docs += [(1000 * n + k, " ".join(x)) for k, x in enumerate(family)]
    chain = rng.choice(vocabulary, 1500).tolist()
    docs += [(90000 + k, " ".join(chain[30 * k : 30 * k + 100])) for k in range(45)]
    low = {i: i for i, _ in docs}
    for (i, x), (j, y) in itertools.combinations(docs, 2):
        if i // 1000 == j // 1000 and jaccard(x, y) >= 0.8:
            a, b = low[i], low[j]
            low = {k: min(a, b) if v in (a, b) else v for k, v in low.items()}
    assert len(set(low.values())) < 100
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block, most in ((512, 1), (16, 6)):
        before = set(Path(common.shared_dir(spark)).glob("near-*"))
        assert {r.id: r.component_id for r in nearcopies.groups(df, block=block).collect()} == low
        new = {x.name.rsplit("-", 1)[0]: spark.read.parquet(str(x)) for x in set(Path(common.shared_dir(spark)).glob("near-*")) - before}
        members, cells = new["near-members"], new["near-cells"]
        assert members.count() > 3 * members.select("sig").distinct().count() == 3 * cells.select("sig").distinct().count()
        assert cells.selectExpr("sum(cuts)").first()[0] <= most * cells.select("sig").distinct().count()
        assert cells.selectExpr("sum(cuts)").first()[0] <= members.selectExpr("sum(cuts)").first()[0]


def test_passages_leave_whole(spark):
    """Passages of 2 to 10 lines and over 50 words leave all later documents whole, whatever is beside them."""
    rng = np.random.default_rng(12)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    docs, want = [], {}
    for p in range(54):
        n = 2 + p % 9
        passage = [line(1 + 51 // n) for _ in range(n)]
        for copy in range(3):
            before, after = [line(int(k)) for k in rng.integers(6, 19, 3)], [line(int(k)) for k in rng.integers(6, 19, 2)]
            docs.append((10 * p + copy, "\n".join([*before, *passage, *after])))
            want[10 * p + copy] = "\n".join([*before, *(passage if copy == 0 else []), *after])
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_short_items(spark):
    """Items of 9 to 20 words are found with as many substitutions as the rule lets pass, wherever they are, and no more."""
    rng = np.random.default_rng(13)
    vocabulary = np.array([f"w{n}" for n in range(20000)])
    items, docs, leaks = [], [], {}
    for n in range(240):
        size = 9 + n % 12
        item = rng.choice(vocabulary, size, replace=False).tolist()
        items.append((n, " ".join(item)))
        most = min(size - 8, int(0.3 * size + 1e-9))
        for kind, gone in enumerate((rng.choice(size, most, replace=False), np.arange(most) * 3 + 2, rng.choice(size, most + 1, replace=False))):
            part = list(item)
            for at in gone:
                part[at] = "other"
            docs.append((10 * n + kind, " ".join([*rng.choice(vocabulary, 30), *part, *rng.choice(vocabulary, 30)])))
            if kind < 2:
                leaks[10 * n + kind] = n
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: r.item_ids for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).where("contaminated").collect()}
    assert all(n in got.get(d, []) for d, n in leaks.items())
    # One more substitution is a leak only by a stretch of agreeing words.
    assert sum(d not in leaks for d in got) < 24


def plain_overlap(here, item):
    """Is an item found on one diagonal? By the rule as the module states it, word by word."""
    same = score = run = best = stretch = 0
    for x, y in zip(here, item, strict=True):
        same += x == y
        if x == y:
            score, run = score + 1, run + 1
        else:
            score, run = max(score - 2, 0), 0 if score <= 2 else run
        if score > best:
            best, stretch = score, run
    return same >= max(decontam.SHARE * len(item), decontam.LEAST) or stretch >= decontam.STRETCH


def test_all_diagonals(spark, monkeypatch):
    """What is found is what a plain search over all diagonals finds, whatever words are substituted; also in many cuts of a document's hits."""
    monkeypatch.setattr(decontam, "HITS_A_ROW", 2)
    rng = np.random.default_rng(23)
    vocabulary = np.array([f"w{n}" for n in range(300)])
    items = {n: rng.choice(vocabulary, int(rng.integers(1, 31))).tolist() for n in range(160)}
    docs = {}
    for n, item in items.items():
        for rate, doc in ((0.1, 10 * n), (0.2, 10 * n + 1), (0.3, 10 * n + 2)):
            part = [w if rng.random() > rate else str(rng.choice(vocabulary)) for w in item]
            docs[doc] = [*rng.choice(vocabulary, rng.integers(0, 20)), *part, *rng.choice(vocabulary, rng.integers(0, 20))]
    want = set()
    for d, words in docs.items():
        for n, item in items.items():
            if len(item) < decontam.SHORTEST:
                found = any(words[a : a + len(item)] == item for a in range(len(words) - len(item) + 1))
            else:
                found = any(plain_overlap([words[a + k] if 0 <= a + k < len(words) else None for k in range(len(item))], item) for a in range(1 - len(item), len(words)))
            if found:
                want.add((d, n))
    frames = (spark.createDataFrame([(k, " ".join(map(str, v))) for k, v in x.items()], f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.id, n) for r in decontam.report(*frames).collect() for n in r.item_ids}
    assert len(want) > 200 and got == want


def test_masks_miss_nothing():
    """Every choice of substituted words that the rule lets pass, and every stretch that it accepts, has a window that a mask fits."""

    def fits(masks, agreeing):
        return any(all(at + k in agreeing for k in mask) for mask in masks for at in agreeing)

    masks = decontam.MASKS
    for n in range(decontam.SHORTEST, 18):
        gone = n - max(decontam.LEAST, math.ceil(decontam.SHARE * n - 1e-9))
        assert all(fits(masks, set(range(n)) - set(x)) for x in itertools.combinations(range(n), gone))
    # Up to 29 words, by bits: a window fits if no place that its mask looks at is among the substituted ones.
    for n in range(18, 24):
        gone = n - max(decontam.LEAST, math.ceil(decontam.SHARE * n - 1e-9))
        sets = np.fromiter((sum(1 << i for i in x) for x in itertools.combinations(range(n), gone)), np.int64)
        for mask in masks:
            for at in range(n - mask[-1]):
                sets = sets[sets & sum(1 << (at + k) for k in mask) != 0]
        assert not len(sets)

    def stretches(so_far, score, place):
        if len(so_far) == decontam.STRETCH:
            yield set(so_far)
            return
        yield from stretches([*so_far, place], score + 1, place + 1)
        if score > 2:
            yield from stretches(so_far, score - 2, place + 1)

    assert all(fits(masks, x) for x in stretches([0], 1, 1))
    assert all(mask[-1] >= len(mask) for mask in masks)
