"""Dedup, mixing, sharding and decontamination against brute force, with nulls, ties, repeats and hot groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cytotide.llm import decontaminate, mixing, sharding, simhash, substring
from cytotide.llm.components import components

RND = random.Random(5)
VOCABULARY = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with nulls, blanks, exact and near copies, shared passages, one long text and a hot group of copies."""
    rnd = random.Random(9)
    base = [prose(rnd.randint(1, 120), rnd) for _ in range(60)]
    passage = prose(45, rnd)
    out = [None, "", " \t\n", "one", "One two", base[0], base[0]] + base
    for t in base[:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [prose(30, rnd) + "\n" + passage + " " + prose(20, rnd) for _ in range(8)]
    out += [prose(10, rnd) + " " + " ".join(passage.split()[5:35]) for _ in range(3)]
    out += [base[1]] * 40 + [passage + " " + passage, prose(6000, rnd), "É È " * 30]
    rnd.shuffle(out)
    return list(enumerate(out))


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, tau):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_classes_match_brute_force(documents, corpus):
    got = {r.doc_id: r for r in simhash.simhash_classes(documents(corpus, extra=True)).collect()}
    fps = [brute_fingerprint(t) for _, t in corpus]
    want = brute_classes(fps, 2)
    assert len(got) == len(corpus)
    for i, _ in corpus:
        assert got[i].fp % 2 ** 64 == fps[i] and got[i].component_id == want[i]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = prose(1000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [2, 64])
def test_links_connect_what_is_near(spark, tau, hot):
    rnd = random.Random(tau * 10 + hot)
    fps = set()
    for _ in range(12):  # clouds around centres, one of them crowded
        centre = rnd.getrandbits(64)
        for _ in range(30 if len(fps) < 5 else 6):
            fps.add(centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) & (2 ** 64 - 1))
    fps = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), tau, hot).collect()
    assert all(bin((r.a ^ r.b) % 2 ** 64).count("1") <= tau for r in found)
    at = {f: i for i, f in enumerate(fps)}
    root = brute_classes([f % 2 ** 64 for f in fps], tau)
    linked = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a bigint, b bigint")).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[linked.get(f, f)].add(root[at[f]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root))


def test_thresholds_are_allocated_by_cost():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0, 2: 99.0}, {-1: 0.0, 0: 50.0, 1: 60.0, 2: 70.0}]
    assert simhash.allocate(costs, 1) == (55.0, [0, 1]) or simhash.allocate(costs, 1)[0] <= 59.0
    best = min(a + b for i, a in costs[0].items() for j, b in costs[1].items() if i + j == 1)
    assert simhash.allocate(costs, 1)[0] == best


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_one_of_each_keeps_one_row_of_a_class(documents, corpus):
    rows = corpus + [(3, corpus[3][1]), (None, "no id at all, but words"), (None, "no id at all, but words")]
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    kept = [r.doc_id for r in simhash.one_of_each(documents(rows, extra=True), columns).collect()]
    roots = brute_classes([brute_fingerprint(t) for _, t in corpus], 2)
    assert sorted(k for k in kept if k is not None) == sorted(set(roots)) and kept.count(None) == 1


# ------------------------------------------------------------------ substrings

def brute_substrings(rows, width=20):
    seen, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    for n, (i, w) in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p:p + width])] < (i, p):
                gone[p:p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[n] = (i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return Counter(out.values())


def test_substrings_match_brute_force(documents, corpus):
    rows = [(i, t) for i, t in corpus]
    twin = next((i, t) for i, t in rows if t and len(t.split()) > 30)
    rows += [twin, (twin[0], "other words before " + twin[1])]  # a repeated row, and another text with that id
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in substring.remove_repeats(documents(rows, extra=True)).collect())
    assert got == brute_substrings(rows)


def test_substring_spans_and_null_ids(documents):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(None, "a " + passage + " b"), (7, passage)]
    got = {r.doc_id: r for r in substring.remove_repeats(documents(rows)).collect()}
    assert got[7].n_removed == 0 and [(s.start, s.end) for s in got[None].spans] == [(1, 26)]


@pytest.mark.parametrize("told", [1 << 18, 0])
def test_rows_of_one_key_are_dealt_to_many_buckets(documents, monkeypatch, tmp_path, told):
    cut = substring._cut

    def watched(texts, repeats):
        if len(texts):
            (tmp_path / str(texts["bucket"].iloc[0])).write_text(str(len(texts)))
        return cut(texts, repeats)

    monkeypatch.setattr(substring, "_cut", watched)
    monkeypatch.setattr(substring, "MOST_REPEATED", told)
    rnd = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(6)]
    text = lambda: " ".join([rnd.choice(passages), *(f"x{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(0, 30))), rnd.choice(passages)])
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, text()) for i in range(600)]
    rows += rows[:3]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(documents(rows)).collect())
    want = brute_substrings([(2 ** 63 - 1 if i is None else i, t) for i, t in rows])
    assert got == Counter({(None if r[0] == 2 ** 63 - 1 else r[0], *r[1:]): n for r, n in want.items()})
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) < 40


def test_rolled_hashes_depend_on_the_run_alone():
    words = np.random.default_rng(1).integers(0, 2 ** 63, 60).astype(np.uint64)
    both = np.concatenate([words, words])
    for width in (1, 2, 10, 20):
        h = substring._rolled(both, width)
        assert len(h) == len(both) - width + 1
        assert (h[:60 - width + 1] == h[60:]).all() and len(set(h[:60 - width + 1])) == 60 - width + 1


# ------------------------------------------------------------------ mixing

def brute_targets(sizes, weights, cap):
    """Shares by weight; sources above their cap stop there and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets(documents, corpus):
    rnd = random.Random(3)
    rows = [(i, t, ("en", rnd.choice(["a", "b", "b", "b", "c", None, "é"]))) for i, t in corpus]
    docs = documents(rows, extra=True)
    got = mixing.mix_documents(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    source = {i: r[1] for i, _, r in rows}
    by_source = defaultdict(int)
    for i in size:
        by_source[source[i]] += size[i]
    targets = brute_targets(by_source, (5, 2, 1), 3)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(docs).collect()), key=str)
    words = defaultdict(int)
    for r in mixing.mixed_copies(docs, ("doc_id", "text", "source", "n_chars")).collect():
        words[r.source] += len((r.text or "").encode().split())
        assert r.text is None or r.n_chars == len(r.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_mix_with_repeated_rows_and_caps(documents):
    rows = [(1, "x y z", ("en", "a"))] * 9 + [(2, "w " * 300, ("en", "b")), (None, "v " * 50, ("en", "c")), (None, "v " * 50, ("en", "c"))]
    got = mixing.mix_documents(documents(rows)).collect()
    assert len(got) == 12 and {(r.target, r.source_size) for r in got if r.source == "a"} == {(81.0, 27)}
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= len(mine)


# ------------------------------------------------------------------ sharding

def shards_of(docs, **kw):
    rows = sharding.shard_rows(docs)
    return sharding.range_shard(rows.select("doc_id", "k1", "k2", "size", "text_crc32"), **kw).collect()


def test_shards_are_near_equal_and_gapless(documents, corpus):
    import zlib
    rows = corpus * 3 + [(10_000 + i, "the same text") for i in range(1500)] + [(None, "no id")]
    texts = Counter((i, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    got = shards_of(documents(rows, extra=True), ranges=64)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == texts
    total, slots = Counter(), defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(r.size for r in got)
    assert max(total[i] for i in range(16)) - min(total[i] for i in range(16)) <= 2 * big
    again = shards_of(documents(rows, extra=True), ranges=64)
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_even_shards_with_a_hot_text(documents):
    rows = [(i, "hot text" if i % 3 else prose(20)) for i in range(3000)]
    got = shards_of(documents(rows), ranges=64)
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert len(total) == 16 and max(total.values()) <= 1.03 * min(total.values())


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(4000).select(F.col("id").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
                                    F.when(F.col("id") < 40, 1000).otherwise(1).cast("bigint").alias("size")).cache()
    for oversample in (1, 32):
        bounds, found = sharding.splitters(rows, ranges=32, oversample=oversample)
        assert sum(r.n for r in found) == 4000 and [r.range for r in found] == sorted({r.range for r in found})
        worst = max((r.bytes / 43960 + r.n / 4000) / 2 * 32 for r in found if r.lo != r.hi)
        assert worst <= max(sharding.OVERFULL, 4.0 if oversample == 1 else 0)
        at = sharding.with_range(rows, bounds).select("k1", "range").collect()
        assert all(r.range == sum(b <= (r.k1, 0) for b in bounds) for r in at)


# ------------------------------------------------------------------ decontamination

def brute_leaks(docs, items, k=5, least=0.8):
    def runs(t, n):
        w = t.lower().encode().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    out = Counter()
    for i, t in docs:
        for j, q in set(items):
            words = len((q or "").split())
            if t and words:
                want = runs(q, min(k, words))
                if len(want & runs(t, min(k, words))) >= least * len(want) - 1e-9:
                    out[i, j] += 1
    return out


def test_leaks_match_brute_force(spark, documents, corpus):
    rnd = random.Random(2)
    items = [(i, prose(rnd.randint(6, 60), rnd)) for i in range(12)] + [(12, "Zeta eta"), (13, None), (14, ""), (0, "again another zeta eta theta iota")]
    rows = list(corpus)
    for n, (_, q) in enumerate(items[:12]):
        w = q.split()
        cut = [x for x in w]
        cut[0] = "lead"
        rows += [(1000 + n, prose(400, rnd) + " " + q.upper() + " " + prose(30, rnd)), (2000 + n, " ".join(cut)),
                 (3000 + n, " ".join(w[:len(w) // 2])), (4000 + n, q)]
    rows += [(5000, "alpha zeta eta beta"), (5001, "alpha zeta beta eta")]
    table = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    docs = documents(rows, extra=True)
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect())
    want = brute_leaks(rows, items)
    assert got == want and want[5000, 12] == 1 and not want[5001, 12]
    kept = {r.doc_id for r in decontaminate.clean(docs, table, ("doc_id", "text")).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}


# ------------------------------------------------------------------ empty tables

def test_empty_tables(spark, documents):
    none = documents([])
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert simhash.simhash_classes(none).count() == 0
    assert simhash.one_of_each(none, ("doc_id", "text")).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert mixing.mix_documents(none).count() == 0 and mixing.mixed_copies(none, ("doc_id", "text")).count() == 0
    assert shards_of(none) == []
    assert decontaminate.leaks(none, empty).count() == 0
    assert decontaminate.leaks(documents([(1, "a b c")]), empty).count() == 0
    assert decontaminate.clean(documents([(1, "a b c")]), empty, ("doc_id",)).count() == 1


def test_small_groups_of_equal_texts_share_a_shard(spark, documents):
    rnd = random.Random(3)
    texts = [prose(rnd.randint(3, 30), rnd) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(rnd.randint(1, 12)))]
    got = sharding.range_shard(sharding.shard_rows(documents(rows)), shards=4, ranges=64, whole_share=0.05).collect()
    assert len(got) == len(rows)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.06 * min(size.values())
    bounds, found = sharding.splitters(sharding.shard_rows(documents(rows)).select("k1", "k2", "size").cache(), shards=4, whole_share=0.05)
    assert len(found) > 100 and sum(r.n for r in found) == len(rows)  # the registered number of ranges, over few rows
