"""Lexical search, conversation repair and the Jaccard join against brute force, with nulls, ties, repeats, hot groups and cuts."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytotide.llm import jaccard, lexical, repair, simhash
from cytotide.llm.common import pick
from cytotide.llm.components import components
from tests_llm_helpers import brute_classes_of

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(docs, items, k=20):
    split = lambda t: TERM.findall(t.translate(ASCII_LOWER)) if t else []
    d = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in d), sum(len(t) for _, t in d)
    df = Counter(t for _, ts in d for t in set(ts))
    out = []
    for item_id, text in items:
        found = []
        for doc, ts in d:
            tf, score = Counter(ts), 0
            for t in split(text):
                if tf[t]:
                    m = 75 + 25 * len(ts) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def search_case():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ["Ab", "c9", "é", "漢字", "zz", "Q"] for b in range(9)]
    say = lambda n: rnd.choice([" ", "-", ", ", "\n"]).join(rnd.choice(words) for _ in range(n))
    docs = [(i, say(rnd.randint(1, 40))) for i in range(90)]
    docs += [(90, None), (91, ""), (92, "!?\x7f"), (None, docs[0][1]), (93, docs[0][1]), (93, docs[0][1]), (94, say(30000)), (7, "Ab1 AB1 ab1")]
    items = [(i, say(rnd.randint(1, 12))) for i in range(9)] + [(9, None), (10, ""), (11, "nothing like it"), (None, "Ab1 c91"), (3, "é0 é0"), (3, "é0 é0")]
    return docs, items


def frames(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, i = (x.select("*", F.lit(1).alias("TEXT"), F.lit("x").alias("rank"), F.lit("x").alias("score"), F.lit("x").alias("item"), F.lit(2).alias("text"))
                for x in (d, i))
    return d, i


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_ranks_equal_brute_force(spark, block_bytes):
    docs, items = search_case()
    d, i = frames(spark, docs, items, extra=True)
    got = lexical.rank(d.repartition(5), i, k=5, block_bytes=block_bytes)
    assert Counter(map(tuple, got.collect())) == brute_rank(docs, items, 5)


def test_ranks_of_empty_tables(spark):
    docs, items = search_case()
    d, i = frames(spark, docs, items)
    assert lexical.rank(d.limit(0), i).count() == 0 and lexical.rank(d, i.limit(0)).count() == 0
    assert lexical.rank(d.where("text is null"), i).columns == ["item_id", "rank", "doc_id", "score"]


def test_products_stay_exact_when_weights_are_cut():
    rnd = random.Random(1)
    items = [{t: rnd.randint(1, 9) for t in rnd.sample(range(50), 12)} for _ in range(7)]
    weights = [rnd.randint(0, 5000) for _ in range(50)]
    numbers = np.array([t for _ in range(4) for t in range(0, 50, 3)], np.int32)
    rows, values = np.repeat(np.arange(4), 17), np.arange(68) % 11 + 1.0
    for tile, bound, width in [(3, 1000, 4), (100, lexical.WEIGHT_BOUND, 4096)]:
        parts = lexical.item_tiles(items, weights, tile, bound, width)
        assert all(np.bincount(c, w).max() <= bound for _, _, products in parts for _, _, c, w in products)
        got = np.concatenate([lexical.tile_scores(p, 4, rows, numbers, values, 50) for p in parts], axis=1)
        want = [[int(sum(held.get(t, 0) * weights[t] * v for r, t, v in zip(rows, numbers, values, strict=True) if r == doc)) for held in items]
                for doc in range(4)]
        assert got.tolist() == want
    assert lexical.WEIGHT_BOUND * lexical.IMPACT_BOUND < 2 ** 53 and lexical.impacts(np.array([10 ** 9]), np.array([75])).max() < lexical.IMPACT_BOUND


def test_terms_of_a_long_text_in_chunks():
    text = ("Ab-é漢 " * 400_000).encode()
    parts = list(lexical.terms(text))
    assert len(parts) > 1 and sum(map(len, parts)) == 800_000 and {t for p in parts for t in p} == {b"ab", "é漢".encode()}


# ------------------------------------------------------------------ conversation repair

def brute_edits(rows):
    """(cost, audit, lines) by exhaustive search in the order of (cost, audit); rows are (role, text, fault)."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, initials, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(lines)
        steps = [(3, "I", 0, x[0], f"{x}:") for x in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps.append((more, "K", 1, role[:1] or "-", f"{role}:{text}"))
                steps += [(3 + more, "R", 1, x[0], f"{x}:{text}") for x in ("user", "assistant")]
        for c, e, step, initial, line in steps:
            if re.fullmatch("s?(ua)*u?", initials + initial):
                heapq.heappush(queue, (cost + c, audit + e, i + step, initials + initial, lines if line is None else (*lines, line)))


def brute_repair(rows, damage):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        by[conv] += [(turn is not None, turn or 0, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    out = set()
    for conv, told in by.items():
        told.sort()
        seen, judged, count = set(), [], Counter()
        for _, _, role, text in told:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            count[fault] += 1
        turns = {t for known, t, _, _ in told if known}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(told))
        cost, audit, lines = brute_edits(judged)
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal,
                 cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines)))
    return out


def conversations():
    rnd = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rnd.randint(0, 6)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rnd.choice([turn, turn, turn, 2, None, turn + 5]), role, rnd.choice(["Hi.", "So", "Is it? \n", "", None, f"word {turn}!", "\t ", "é"])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, 1, "user", "Hi.")]
    rows += [(100, -2 ** 62, "user", "A."), (100, 2 ** 62, "assistant", "B.")]
    return rows


@pytest.mark.parametrize(("damage", "segment_rows"), [(True, 4096), (True, 2), (False, 1), (False, 3)])
def test_repair_equals_brute_force(spark, damage, segment_rows):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.select("*", F.lit("x").alias("Role"), F.lit("x").alias("copies"), F.lit("x").alias("role"))
    told = repair.counted_rows(repair.damaged(df), F.col("copies")) if damage else repair.counted_rows(df)
    solved = repair.solve(told, segment_rows).collect()
    want = brute_repair(rows, damage)
    got = {(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in solved if r.audit is not None}
    assert got == {x[:-1] for x in want} and sum(r.audit is not None for r in solved) == len(want)
    texts = defaultdict(list)
    for r in sorted(solved, key=lambda r: (r.part, r.no)):
        texts[r.conv_id] += [r.repaired] if r.repaired else []
    assert all("\n".join(texts[x[0]]) == x[-1] for x in want)


def test_repair_of_an_empty_table_and_a_conversation_of_one_kind(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, i, "user", f"Say {i}.") for i in range(700)] + [(1, 700 + i, "user", "Again.") for i in range(300)]
    got = repair.solve(repair.counted_rows(spark.createDataFrame(rows, schema)), 50).where("audit is not null").collect()
    assert len(got) == 1 and got[0].duplicate == 299 and got[0].cost == 299 * 4 + 701 // 2 * 3 + 3 * (701 % 2)
    assert len(got[0].audit.replace("I", "")) == 1000


def test_folded_layers_have_the_same_least_paths():
    rnd = random.Random(8)
    for _ in range(40):
        layers = [repair.row_layer(rnd.choice(["user", "assistant", "system", "x"]), rnd.random() < 0.3) if rnd.random() < 0.8 else repair.deleted_layer(rnd.randint(1, 3))
                  for _ in range(rnd.randint(0, 40))]
        whole = repair.search([*layers, repair._TAIL], repair.START, (repair.START, "a"))
        assert repair.search([*repair.folded(layers, 3), repair._TAIL], repair.START, (repair.START, "a")) == whole


# ------------------------------------------------------------------ Jaccard join

def brute_shingles(text):
    w = (text or "").translate(ASCII_LOWER).encode().split()
    return frozenset(b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_jaccard(rows):
    sets = [(i, brute_shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    return Counter((doc, len(x), least[find(i)]) for i, (doc, x) in enumerate(sets))


def changed(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near_copies():
    rnd = random.Random(6)
    say = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    texts = [None, "", " \n", "One", "one", "one two three four", "ONE  two\tthree four"]
    for size in (5, 6, 8, 9, 11, 14, 20, 30, 60, 150, 400):
        for _ in range(3):
            base = say(size)
            texts += [" ".join(base), " ".join(base[:-1]), " ".join(base) + " tail", *[changed(rnd, base, max(1, size // f)) for f in (60, 40, 25)]]
    base, line = say(120), say(14)
    texts += [changed(rnd, base, rnd.randint(1, 5)) for _ in range(40)] + [" ".join(base)] * 25          # a large group of near copies
    texts += [" ".join([*line, *say(2)]) for _ in range(30)] + [" ".join([*say(40), *line]) for _ in range(30)]  # a common line
    texts += [" ".join(say(9000))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(None, texts[5]), (3, texts[40]), (3, texts[40]), (None, "only here it is said so")]


@pytest.mark.parametrize("hot", [32, 3])
def test_jaccard_classes_equal_brute_force(spark, documents, near_copies, hot):
    df = documents(near_copies, extra=True).repartition(4)
    got = jaccard.jaccard_classes(df, hot=hot)
    assert Counter(map(tuple, got.collect())) == brute_jaccard(near_copies)


@pytest.mark.parametrize("listed", [1, 300])
def test_pivots_lose_no_link(spark, listed):
    """Sets around each other on one hot signature: chains, shells and strangers."""
    rnd = random.Random(2)
    base, words = [f"b{i}" for i in range(80)], {}
    for i in range(60):
        words[i] = base[:]
        for _ in range(rnd.choice([1, 2, 3, 5, 9])):
            words[i][rnd.randrange(80)] = f"x{rnd.randrange(40)}"
    rows = [(i, " ".join(w)) for i, w in words.items()]
    d = pick(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    keyed = jaccard.keyed(d).cache()
    held = jaccard.feature_sets(d).dropDuplicates(["k1", "k2"]).cache()
    some = jaccard.with_own(held, jaccard.THRESHOLD)
    assert 0 < some.count() < held.count()
    found = jaccard.crowded_links(some, keyed.dropDuplicates(["k1"]), held, jaccard.THRESHOLD, listed)
    roots = {r.node: r.root for r in components(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).collect()}
    node = {r.doc_id: r.node for r in keyed.select("doc_id", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")).alias("node")).collect()}
    classes = defaultdict(set)
    for i in words:
        classes[roots.get(node[i], node[i])].add(i)
    want = defaultdict(set)
    for (doc, _, least), _ in brute_jaccard(rows).items():
        want[least].add(doc)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values())) and 1 < len(want) < 60


@pytest.mark.parametrize("told", [False, True])
def test_families_list_only_pairs_that_sketches_allow(spark, monkeypatch, told):
    """Near copies of one text that are mostly too far apart: their family isn't listed as all its pairs, nor are sets that known links connect."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(70):
        w = base[:]
        for at in rnd.sample(range(400), 4 if i < 12 else rnd.randint(14, 20)):
            w[at] = f"x{rnd.randrange(30)}"
        rows.append((i, " ".join(w)))
    d = pick(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    keyed = jaccard.keyed(d).cache()
    held = jaccard.feature_sets(d).dropDuplicates(["k1", "k2"]).cache()
    node = {r.doc_id: r.node for r in keyed.select("doc_id", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")).alias("node")).collect()}
    shingles = [brute_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(70) for j in range(i) if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])]
    known = spark.createDataFrame([(node[i], node[j]) for i, j in links if i < 12], "node_a string, node_b string") if told else None
    listed, likely, compared = [], jaccard.likely, jaccard.compared
    monkeypatch.setattr(jaccard, "PART_SETS", 9)
    monkeypatch.setattr(jaccard, "likely", lambda pairs, *more: (listed.append(pairs.count()), likely(pairs, *more))[1])
    monkeypatch.setattr(jaccard, "compared", lambda pairs, *more, **named: (listed.append(pairs.count()), compared(pairs, *more, **named))[1])
    some = held.select("k1", F.size("features").alias("n"), F.lit(0).alias("own"))
    found = jaccard.crowded_links(some, keyed.dropDuplicates(["k1"]), held, jaccard.THRESHOLD, 10 ** 6, *([known] if told else []))
    edges = [tuple(r) for r in (found.unionByName(known) if told else found).collect()]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    classes = {least for _, _, least in brute_jaccard(rows)}
    assert len({roots.get(n, n) for n in node.values()}) == len(classes) < 70 and {tuple(sorted(e)) for e in edges} <= {tuple(sorted((node[i], node[j]))) for i, j in links}
    assert max(listed) < 70 * 69 // 2 // 4, (listed, len(links))


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(1)
    draw = lambda n: rnd.integers(0, 2 ** 63, n, dtype=np.uint64)
    for size in [4, 5, 6, 7, 9, 12, 17, 25, 40, 90, 200, 700]:
        for _ in range(25):
            a = draw(size)
            lost, more = int(rnd.integers(0, size // 5 + 1)), int(rnd.integers(0, size // 4 + 1))
            b = np.concatenate([a[lost:], draw(more)])
            if 100 * (size - lost) < 80 * (size + more):
                continue
            x, y = (set(np.concatenate([s for _, _, s in jaccard.signatures(np.unique(v), jaccard.masses(np.unique(v)))] or [[0]]).tolist()) for v in (a, b))
            assert x & y, (size, lost, more)
            x, y = (set(jaccard.wide_signatures(np.unique(v), jaccard.masses(np.unique(v))).tolist()) for v in (a, b))
            assert size == len(b) == len(set(a) & set(b)) or x & y, (size, lost, more)


def test_sketches_differ_in_no_more_cells_than_sets(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in (3, 300, 683, 700, 1400, 5000):
        a = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
        for kept, more in ((0.9, 0.1), (0.95, 0.2), (0.5, 0.5), (0.0, 1.0)):
            b = np.unique(np.concatenate([a[int(size * (1 - kept)):], rng.integers(0, 2 ** 63, int(size * more), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            rows.append(((len(a), jaccard.sketch(a)), (len(b), jaccard.sketch(b)), shared / (len(a) + len(b) - shared)))
    kind = "struct<n:long,sketch:array<long>>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}, similarity double").select("similarity", jaccard._may_share("a", "b", (80, 100)).alias("may")).collect()
    assert all(r.may for r in got if r.similarity >= 0.8) and not any(r.may for r in got if r.similarity < 0.6 and r.similarity < 1)
    assert any(len(r[0][1]) != len(r[1][1]) for r in rows)


def test_jaccard_of_empty_tables(spark, documents):
    assert jaccard.jaccard_classes(documents([(1, "a")]).limit(0)).count() == 0
    assert jaccard.jaccard_classes(documents([(1, None), (None, "")])).collect() == [(1, 0, 1), (None, 0, None)]


# ------------------------------------------------------------------ components, and compiled plans over many partitions

def test_components_in_rounds_and_in_one_task(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(i, find(i)) for i in list(root) if find(i) != i}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == want
    assert {tuple(r) for r in components(df, finish_bytes=1).collect()} == want
    named = components(df.select(F.format_string("n%05d", "a").alias("a"), F.format_string("n%05d", "b").alias("b")))
    assert {tuple(r) for r in named.collect()} == {(f"n{i:05d}", f"n{r:05d}") for i, r in want}


def test_simhash_with_compiled_plans_and_many_partitions(spark, documents):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(200)}" for _ in range(80)]
    texts = [" ".join(f"w{rnd.randrange(200)}" for _ in range(40)) for _ in range(60)] + [changed(rnd, base, 1) for _ in range(90)]
    texts += [" ".join(base)] * 60
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.shuffle.partitions": "200",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = simhash.simhash_classes(documents(list(enumerate(texts)))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in got} == brute_classes_of(dict(enumerate(texts))) and len(got) == len(texts)
