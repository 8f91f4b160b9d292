"""Filter audit, SimHash tiles and source divergence against plain Python on small odd tables."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from encircle.llm import divergence, filter_audit, simhash_tiles
from encircle.llm.queries import QUERIES

RNG = random.Random(11)
WORDS = [f"word{i}" for i in range(300)] + ["Äpfel", "ÉTÉ", "漢字", "straße"]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, part STRING, mask INT, print BIGINT, n INT"


def sentence(n, words=WORDS):
    return " ".join(RNG.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [sentence(n) for n in (3, 20, 49, 50, 51, 80, 200, 400, 60, 60)]
    copies = [base[5]] * 30 + [base[7].replace(" word1 ", f" new{i} ") for i in range(20)]
    odd = [None, "", "  \n\t", "one", "one two three", "A" * 60, sentence(30_000), "x\x00y\x1cZ #tag", "word1 " * 70]
    texts = base + copies + odd + [sentence(100, WORDS[:40]) for _ in range(60)] + [sentence(90).upper()] * 3
    made = [(i, t, (None, "en", "de")[i % 3], (None, "", "b", "a&b")[i % 4], "x", 9, 1, 2) for i, t in enumerate(texts)]
    made += [made[12], made[12], (None, base[5], "en", "b", "x", 9, 1, 2), (None, None, None, None, None, None, None, None)]
    RNG.shuffle(made)
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, 1, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    return spark.createDataFrame(made, "doc_id BIGINT, quality INT, toxic INT")


def audit_of(rows, labels):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = ({r.doc_id for r in labels if r[k] == 1 and r.doc_id is not None} for k in ("quality", "toxic"))
    facts = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and smallest[t] < i,
        }
        facts.append((source or "", {f for f in failed if failed[f]}, i in good, i in toxic))
    expected = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [f for f in mine if letter in f[1] and not f[1] & before]
                removed[letter] += len(gone)
                expected[part, order, step] = [
                    sum(not f[1] & (before | {letter}) for f in mine), len(gone),
                    sum(letter in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
        for (p, order, step), figures in expected.items():
            if p == part:
                figures.append(removed[order[step - 1]])
    return {key: tuple(figures) for key, figures in expected.items()}


def test_audit_equals_plain_filters(docs, labels, rows):
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == audit_of(rows, labels.collect())


def test_audit_restores_the_limit_and_allows_many_parts(spark, docs, labels, monkeypatch):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        assert filter_audit.audit(docs, labels).count() == 600 * 3
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "100"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_audit_of_nothing(docs, labels):
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


# --- SimHash ---------------------------------------------------------------------------------


def fingerprint_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, radius=4):
    """Index of the first member of every position's component."""
    first = list(range(len(prints)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            first[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two three", "a b c d", "A b C d e", sentence(500), "Äb ÄB \x1c\x85 x"):
        assert simhash_tiles.fingerprint(text) % (1 << 64) == fingerprint_of(text)


@pytest.mark.parametrize("least", [5, 1 << 10])
def test_near_duplicates_equal_all_pairs(docs, rows, least, monkeypatch):
    monkeypatch.setattr(simhash_tiles, "TILE_LEAST", least)
    prints = [fingerprint_of(r[1]) for r in rows]
    roots = classes_of(prints)
    smallest = {}
    for root, row in zip(roots, rows):
        if row[0] is not None:
            smallest[root] = min(smallest.get(root, row[0]), row[0])
    expected = sorted(((r[0], p, smallest.get(root)) for r, p, root in zip(rows, prints, roots)), key=str)
    found = simhash_tiles.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in found), key=str) == expected


def test_components_without_ids_and_empty_tables(spark, docs):
    bare = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id BIGINT, text STRING")
    assert [r.component_id for r in simhash_tiles.near_duplicates(bare).collect()] == [None, None]
    assert simhash_tiles.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_forest_connects_what_links_connect(same, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(-(1 << 62), 1 << 62, 40)
    noise = np.array([sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 6))) for _ in range(900)])
    prints = np.unique(rng.choice(centres, 900) ^ noise)
    a, b = (prints, prints) if same else (prints[::2], prints[1::2])
    left, right = simhash_tiles.forest(a, b, radius, same)
    unsigned = [int(x) % (1 << 64) for x in prints]
    assert all((int(x) ^ int(y)).bit_count() <= radius for x, y in zip(left.view(np.uint64), right.view(np.uint64)))
    assert len(left) < len(prints)
    position = {p: i for i, p in enumerate(unsigned)}

    def connected(pairs):
        first = list(range(len(prints)))

        def root(i):
            while first[i] != i:
                i = first[i]
            return i

        for i, j in pairs:
            x, y = sorted((root(i), root(j)))
            first[y] = x
        return [root(i) for i in range(len(prints))]

    wanted = (
        (i, j) for i, j in itertools.combinations(range(len(prints)), 2)
        if (same or i % 2 != j % 2) and (unsigned[i] ^ unsigned[j]).bit_count() <= radius
    )
    made = ((position[int(x) % (1 << 64)], position[int(y) % (1 << 64)]) for x, y in zip(left, right))
    assert connected(made) == connected(wanted)


def test_a_dense_group_reports_no_pairs(spark):
    """2,000 fingerprints that nearly all link: the links that leave the tasks stay a few per print and tile pair."""
    near = spark.range(2000).select(
        F.expr("shiftleft(1L, cast(id % 45 as int)) ^ shiftleft(1L, cast((id div 45) % 60 as int))").alias("print")
    ).distinct()
    n = near.count()
    tiles = simhash_tiles.tiles(near).count()
    found = simhash_tiles.links(near).count()
    assert found < n * (tiles + 1)


# --- divergence ------------------------------------------------------------------------------


def divergences_of(rows, least, ranks):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [w.encode().lower().decode() for w in term.findall(text or "")]
        groups.setdefault(lang, set()).add(source)
        for w in found:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(found):
            held[lang, w] = held.get((lang, w), 0) + 1
    result = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in held.items() if g == lang and n >= least]
        v = len(kept)

        def share(count, n):
            return 1 + 10**9 * (count + 5) // (n + 5 * v)

        def shares(of):
            n = {w: sum(counts.get((lang, s, w), 0) for s in of) for w in kept}
            return n, {w: share(n[w], sum(n.values())) for w in kept}

        whole = shares(sources)[1]
        by = {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(t, sum(abs(by[s][1][w] - by[t][1][w]) for w in kept)) for t in sources if t != s]
            above = [(w, by[s][1][w] - whole[w]) for w in kept if by[s][0][w] and by[s][1][w] > whole[w]]
            for part, items, most in (("pair", pairs, None), ("term", above, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                result += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(result)


@pytest.mark.parametrize("least, ranks, cells, tile", [(5, 50, 1 << 17, 1024), (2, 7, 64, 2), (10_000, 50, 64, 1)])
def test_divergences_equal_plain_counts(docs, rows, least, ranks, cells, tile, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PENDING", 500)
    monkeypatch.setattr(divergence, "SPLIT_BYTES", 2000)
    got = divergence.divergences(docs, least, ranks).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == divergences_of(rows, least, ranks)


def test_shares_of_huge_counts():
    counts = np.array([0, 1, 10**14, 9 * 10**15], np.int64)
    whole = 9 * 10**15 + 17
    assert divergence._share(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]


def test_divergences_of_nothing(docs):
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_filter_audit", "op12_simhash", "op13_source_divergence"} <= set(QUERIES)
