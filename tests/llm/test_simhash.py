import random
import re
import time

import numpy as np
import pytest
import xxhash

from opinara.llm import simhash
from opinara.llm._shared import give_back


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """points: (id, fingerprint); the smallest id that each reaches over at most two differing bits."""
    label = list(range(len(points)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(points):
        least.setdefault(find(i), []).append(key)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(points))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    points = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(points, brute_components(points), strict=True)), key=repr)
    got = simhash.simhash_groups(df, keep=["doc_id"]).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=repr) == want


def test_tables(documents, odd_documents, no_documents):
    check(documents)
    check(odd_documents)
    check(no_documents)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        chance = random.Random(1)
        for _ in range(500):
            differ = sum(1 << b for b in chance.sample(range(64), radius))
            assert any(m & differ == 0 for m in masks)


def test_crowded_buckets_lose_no_link(spark):
    chance = random.Random(7)
    centre = chance.getrandbits(63)
    values = {centre ^ sum(1 << b for b in chance.sample(range(64), chance.randint(0, 3))) for _ in range(400)} | {chance.getrandbits(63) for _ in range(50)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    points = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_components([(v, v & (1 << 64) - 1) for v in values])
    roots = {r.node: r.root for r in simhash.connected_components(simhash.links_within(points, 2, pair_limit=8)).collect()}
    pairs = {}
    for v, w in zip(values, want, strict=True):
        pairs.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(x) == 1 for x in pairs.values()) and len({min(x) for x in pairs.values()}) == len(pairs)


def test_columns_are_carried(odd_documents):
    out = simhash.simhash_groups(odd_documents)
    assert set(out.columns) == set(odd_documents.columns) and out.count() == odd_documents.count()


def test_every_radius_links_all_pairs_without_pairs_in_crowds(spark):
    """pair_limit 0: every bucket is a crowd; the components are those of all pairs within the radius."""
    chance = random.Random(4)
    base = [chance.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in chance.sample(range(64), chance.randint(0, 4))) for b in base for _ in range(12)})
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for radius in range(5):
        for limit in (0, 64):
            if radius > 2 and not limit:
                points_ = points.limit(20)
            else:
                points_ = points
            mine = [r.fp & ((1 << 64) - 1) for r in points_.collect()]
            edges = {(r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)) for r in simhash.links_within(points_, radius, limit).collect()}
            assert all((a ^ b).bit_count() <= radius for a, b in edges)
            label = {f: f for f in mine}

            def top(x, label=label):
                while label[x] != x:
                    x = label[x]
                return x

            for a, b in edges:
                label[max(top(a), top(b))] = min(top(a), top(b))
            assert all(top(a) == top(b) for a in mine for b in mine if (a ^ b).bit_count() <= radius)
    with pytest.raises(ValueError):
        simhash.links_within(points, 5)


def jaccard(a, b):
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    x, y = (cut((t or "").lower().split()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_by_shingles(spark, documents, odd_documents, no_documents):
    chance = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    texts = [[chance.choice(words) for _ in range(chance.choice([1, 3, 60, 200, 900]))] for _ in range(60)]
    copies = []
    for t in texts:
        for _ in range(3):
            c = list(t)
            for _ in range(len(c) // 90):
                c[chance.randrange(len(c))] = chance.choice(words)
            copies.append(c)
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *copies, *texts[:10]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, keep=["doc_id"]).collect()}
    assert len(out) == len(rows)
    linked = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8]
    assert sum(out[a] == out[b] for a, b in linked) > 0.95 * len(linked)
    assert all(out[a] == out[b] for a, b in linked if rows[a][1] == rows[b][1])
    # no group that links don't make: each member is near some other of its group
    text = dict(rows)
    for i, c in out.items():
        others = [j for j, d in out.items() if d == c and j != i]
        assert not others or max(jaccard(text[i], text[j]) for j in others) >= 0.8
    some = simhash.near_duplicate_groups(df, keep=["doc_id"], pair_limit=1)
    assert {r.doc_id: r.component_id for r in some.collect()} == out  # no bucket's size costs a link
    odd = simhash.near_duplicate_groups(odd_documents)
    assert odd.count() == odd_documents.count() and set(odd.columns) == set(odd_documents.columns)
    assert simhash.near_duplicate_groups(no_documents).count() == 0


def test_pairs_by_rarest_shingles_are_all_pairs(spark):
    chance = random.Random(5)
    sets = [set(chance.sample(range(60), chance.randint(1, 40))) for _ in range(80)]
    sets += [set(chance.sample(sorted(s), max(1, len(s) * 9 // 10))) | {100 + chance.randrange(9)} for s in sets]
    rows = [(i, i // 2, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "u long, root long, s array<long>")
    for similarity in (0.5, 0.8):
        got = {(r.a, r.b) for r in simhash._rare_pairs(df, similarity).collect()}
        want = {(a, b) for a, ra, x in rows for b, rb, y in rows if a < b and ra != rb and len({*x} & {*y}) >= similarity * len({*x} | {*y})}
        assert want and want <= got and all(rows[a][1] != rows[b][1] for a, b in got)


def test_a_crowd_under_a_template_loses_no_pair_for_its_size(spark):
    """Texts that share most words with all others (similarity under 0.8), with a near copy of each planted among them."""
    chance = random.Random(6)
    template = [f"t{i}" for i in range(300)]
    rows, want = [], []
    for n in range(150):
        own = [f"o{n}x{i}" for i in range(50)]
        a = template + own
        b = list(a)
        b[-1] = f"c{n}"
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        want.append((2 * n, 2 * n + 1))
    assert 0.7 < jaccard(rows[0][1], rows[2][1]) < 0.8 and jaccard(rows[0][1], rows[1][1]) > 0.95
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, keep=["doc_id"], pair_limit=1 << 20).collect()}
    crowd = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, keep=["doc_id"], pair_limit=4).collect()}
    assert crowd == full
    assert all(a // 2 == b // 2 for a, b in crowd.items())  # each pair by itself
    assert sum(crowd[a] == crowd[b] for a, b in want) >= 0.99 * len(want)


def test_a_crowd_of_near_copies_costs_no_pairs(spark, monkeypatch):
    """Copies of one text with one to twelve changed words: some similar to nearly all others, some to none. Small buckets hold many of the same pairs."""
    chance = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(500):
        t = list(base)
        for _ in range(chance.randint(1, 12)):
            t[chance.randrange(len(t))] = f"e{chance.randrange(10**6)}"
        rows.append((n, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compared = []
    write = simhash.written
    monkeypatch.setattr(simhash, "_rare_pairs", lambda *a, keep=simhash._rare_pairs: compared.append(keep(*a)) or compared[-1])
    sizes = []

    def spy(out, name, **more):
        out = write(out, name, **more)
        if name in ("dense", "rare"):
            sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "written", spy)
    crowd = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, keep=["doc_id"], pair_limit=8).collect()}
    assert dict(sizes)["dense"] > 300 and dict(sizes)["rare"] < 0.3 * 146 * 500  # only the first shingles become rows
    assert sum(p.count() for p in compared) < 5 * len(rows)
    monkeypatch.undo()
    full = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df, keep=["doc_id"], pair_limit=1 << 20).collect()}
    groups = lambda x: sorted(sorted(k for k in x if x[k] == c) for c in set(x.values()))
    assert [g for g in groups(full) if len(g) > 1] and all(any(set(g) <= set(h) for h in groups(crowd)) for g in groups(full))  # no link is lost
    text = dict(rows)
    for g in groups(crowd):
        assert len(g) == 1 or all(any(jaccard(text[a], text[b]) >= 0.8 for b in g if b != a) for a in g)


def test_tally_counts_each_hash(spark):
    chance = random.Random(3)
    sets = [sorted({chance.randrange(40) - 20 for _ in range(9)}) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in sets], "s array<long>").repartition(5)
    want = np.bincount(simhash._slots(np.concatenate([np.array(s) for s in sets])), minlength=1 << 18)
    assert (simhash._tally(df) == want).all()
    assert not simhash._tally(df.limit(0)).any()


def test_texts_are_cut_in_place(spark, documents, monkeypatch):
    """No text is shuffled for its shingles, and rows that the bitmap lets pass in vain change nothing."""
    plans, write, want = [], simhash.written, None
    monkeypatch.setattr(simhash, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    for bits in (simhash.bitmap, lambda hashes: np.full(1 << 21, 255, np.uint8)):
        monkeypatch.setattr(simhash, "bitmap", bits)
        got = sorted(map(tuple, simhash.near_duplicate_groups(documents, keep=["doc_id"]).collect()))
        assert want is None or got == want
        want = got
    cut = [plan for name, plan in plans if name == "shingles" and "text" in plan]
    assert len(cut) == 2
    assert not any("Join" in plan for plan in cut)


def test_shuffles_of_ended_steps_go(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    give_back(spark)
    time.sleep(1)
    before = files().size()
    spark.range(100_000).repartition(7).groupBy("id").count().collect()
    assert files().size() > before
    until = time.time() + 20
    while files().size() > before and time.time() < until:  # Spark's listeners and its cleaner work aside
        give_back(spark)
        time.sleep(0.2)
    assert files().size() <= before
