"""N-gram Jaccard join: size-aware, heavy sets by inverted lists, light sets by fixed-size subsets.

Two documents link when the Jaccard similarity of their sets of word shingles is high enough.
The join is exact on 64-bit shingle hashes:

1. *Counts.*  Every task counts the shingles of its documents; the counts meet in ranges of hash
   values and leave one byte per slot of a fixed table: about log2 of the number of documents a
   shingle occurs in, 0 for a single one.  Slots that are shared by chance only change the order
   of shingles, and the same way for every document.
2. *Keys.*  A set is ordered by (slot level, hash), rare shingles first.  Linked sets share one of
   their first n - ceil(t n) + 1 shingles: a heavy set enters those inverted lists.  Light sets
   enter one list per *pair* of their first n - ceil(t n) + 2 shingles, since linked sets share two
   of those; pair lists are much shorter.  Where light ends is chosen by cost: the largest size at
   which writing all pairs costs no more than scanning the lists of single shingles.  Light sets
   that may meet a heavy one enter single lists too.  Shingles of one document have no list.
3. *Scan.*  Equal sets are one.  Each set is first compared with the most central leader of its
   lists, then with that of another component; lists whose members are then connected are finished
   without looking at pairs.  In the others, members of different components are compared; in long
   lists those outside the largest component with all, in blocks, so that no task holds a whole list.
4. *Check.*  Candidates are compared shingle by shingle, those of blocks where they meet.  A pair
   of blocks reports a spanning forest of its links, never its pairs.  Links join components.

Nulls and texts without words have empty sets and link with nothing.  A null id takes part but
names nothing: a component's id is its smallest id that is not null.  Repeated rows are equal sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.llm.components import connected_components
from encircle.llm.shared import give_back, in_slices, written

#: The table of shingle levels has 2^SLOT_BITS bytes: the size bound of the one thing broadcast.
SLOT_BITS = 25
#: Bits of a shingle hash by which occurrences are counted.
COUNT_BITS = 40
#: Occurrences a task gathers before it sends counts.
CHUNK = 2_000_000
#: Words a task remembers the hashes of.
WORD_CACHE = 1 << 18
#: Members of a list that is joined with itself, and members and shingles of a block of a longer one.
SHORT_LIST, BLOCK, BLOCK_SHINGLES = 64, 512, 1 << 20
#: Rounds after the first, in which every set is compared with a leader of another component.
MORE_LEADERS = 1
SKETCH = 128
#: Bits of the table that tells which documents surely stay: the size bound of its broadcast.
GONE_BITS = 27


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked at ``percent`` of Jaccard similarity."""

    words: int = 5
    percent: int = 80

    def needed(self, n: int) -> int:
        """Shingles of a set of n that any linked set holds at least."""
        return -(-self.percent * n // 100)

    def linked(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)


class _Hashes(dict):
    """Word hashes; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    # bytes.lower() changes A-Z only, bytes.split() cuts at the white space of ASCII
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    count = len(w) - k + 1
    h = np.zeros(count, np.uint64)
    for j in range(k):
        h = h * _MULTIPLIER + w[j : j + count]
    return np.unique(_mixed(h))


# --- counts ----------------------------------------------------------------------------------


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct values below 2^COUNT_BITS and their counts."""
    gaps = np.diff(values, prepend=np.uint64(0))
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[: COUNT_BITS // 8]
    tops = np.minimum(counts, 0xFFFF).astype("<u2").tobytes()
    return zstandard.compress(planes.tobytes() + tops, 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    width = COUNT_BITS // 8
    n = len(raw) // (width + 2)
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n)
    gaps = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, "<u2", n, n * width)


def _occurrences(k: int, part_bits: int):
    """Per task: counts of the shingles of its documents, in 2^part_bits ranges of hash values."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        starts = np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(COUNT_BITS - part_bits)
        cuts = np.searchsorted(values, starts)
        rows = [(p, _packed(values[i:j], counts[i:j])) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            ["part", "blob"],
        )

    def run(batches):
        hashes, held, size = _Hashes(), [], 0
        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                found = shingles(text, k, hashes) >> np.uint64(64 - COUNT_BITS)
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)
        hashes = held = None
        give_back()

    return run


def _levels(part_bits: int):
    """Counts of one range: its slots of the level table, shingles in several documents, their counts."""
    width = COUNT_BITS - part_bits
    slots = 1 << (SLOT_BITS - part_bits)

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        parts = [_unpacked(blob) for blob in group.column("blob").to_pylist()]
        values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        totals = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
        several = totals >= 2
        values, totals = values[several], totals[several]
        level = np.minimum(np.log2(totals).astype(np.int64), 255).astype(np.uint8)
        slot = ((values & np.uint64((1 << width) - 1)) >> np.uint64(COUNT_BITS - SLOT_BITS)).astype(np.int64)
        made = np.zeros(slots, np.uint8)
        np.maximum.at(made, slot, level)
        return pa.table(
            {
                "part": pa.array([part], pa.int32()),
                "slots": pa.array([zstandard.compress(made.tobytes(), 1)], pa.binary()),
                "several": pa.array([len(totals)], pa.int64()),
                "occurrences": pa.array([int(totals.sum())], pa.int64()),
            }
        )

    return run


def shingle_levels(texts: DataFrame, k: int) -> tuple[bytes, float]:
    """The level table over all documents, and the mean length of a list of several documents.

    A range holds about CHUNK occurrences: there are as many ranges as the input has partitions,
    times eight.  The driver gets 2^SLOT_BITS bytes at most.
    """
    partitions = max(32, texts.rdd.getNumPartitions())
    part_bits = min(20, (8 * partitions - 1).bit_length())
    counted = texts.mapInArrow(_occurrences(k, part_bits), "part INT, blob BINARY")
    ranges = counted.groupBy("part").applyInArrow(
        _levels(part_bits), "part INT, slots BINARY, several LONG, occurrences LONG"
    )
    size = 1 << (SLOT_BITS - part_bits)
    levels = bytearray(1 << SLOT_BITS)
    several = occurrences = 0
    for row in ranges.collect():
        levels[row.part * size : (row.part + 1) * size] = zstandard.decompress(row.slots)
        several += row.several
        occurrences += row.occurrences
    return bytes(levels), occurrences / several if several else 2.0


def light_boundary(rule: Rule, length: float) -> int:
    """Largest size up to which subsets cost no more than lists of the given mean length."""
    n = 1
    while True:
        first = n + 1 - rule.needed(n + 1) + 1
        if (first + 1) * first / 2 > first * (1 + length):
            return n
        n += 1


# --- keys ------------------------------------------------------------------------------------


def list_keys(found: np.ndarray, level: np.ndarray, rule: Rule, boundary: int) -> np.ndarray:
    """The lists that a set (sorted hashes and their levels) enters."""
    n = len(found)
    if n == 0:
        return found
    first = n - rule.needed(n) + 1
    head = np.argsort(level, kind="stable")[: first + 1]
    singles = found[head[:first]][level[head[:first]] > 0]
    if n > boundary:
        return singles
    shared = np.sort(found[head][level[head] > 0])
    i, j = np.triu_indices(len(shared), 1)
    pairs = _mixed(shared[i] * _PAIR ^ shared[j])
    meets_heavy = n >= rule.needed(boundary + 1)
    return np.concatenate([singles, pairs]) if meets_heavy else pairs


def _described(rule: Rule, boundary: int, levels: Broadcast):
    def run(batches):
        hashes, table = _Hashes(), np.frombuffer(levels.value, np.uint8)
        rid = TaskContext.get().partitionId() << 40
        for batch in in_slices(batches):
            rows = []
            for text in batch.column("_text").to_pylist():
                found = shingles(text, rule.words, hashes)
                level = table[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                keys = list_keys(found, level, rule, boundary)
                signature = _mixed(found ^ _PAIR).sum(dtype=np.uint64), found.sum(dtype=np.uint64)
                held = len(keys) > 0
                rows.append(
                    (
                        rid,
                        len(found),
                        int(np.count_nonzero(level == 0) * 1000 // max(1, len(found))),
                        *(int(s.astype(np.int64)) for s in signature),
                        keys.astype(np.int64),
                        found.tobytes() if held else None,
                        np.minimum(np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255)
                        .astype(np.uint8).tobytes() if held else None,
                    )
                )
                rid += 1
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_mark"), *arrays],
                ["_id", "_mark", "rid", "n", "alone", "s1", "s2", "keys", "shingles", "sketch"],
            )
            del batch, rows, columns, arrays
        hashes = None
        give_back()

    return run


# --- scan and check --------------------------------------------------------------------------


def _sizes_fit(rule: Rule, n: Column, m: Column) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * rule.percent)


def _close_sketches(rule: Rule):
    """Keeps pairs whose sketches allow enough common shingles: the difference of two sets is at
    least the difference of their (capped) counts per bucket."""

    def run(batches):
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8).reshape(-1, SKETCH)
            b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8).reshape(-1, SKETCH)
            apart = np.abs(a.astype(np.int16) - b).sum(axis=1)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = (both - apart) // 2
            fits = 100 * most >= rule.percent * (both - most)
            yield batch.filter(pa.array(fits)).select(["a", "b"])

    return run


def _linked(rule: Rule):
    def run(batches):
        for batch in in_slices(batches):
            kept = []
            columns = (batch.column(c) for c in ("shingles_a", "shingles_b"))
            for x, y in zip(*columns):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(rule.linked(common, len(p), len(q)))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return run


def _checked(pairs: DataFrame, sets: DataFrame, rule: Rule, prune: bool) -> DataFrame:
    """The linked ones of candidate pairs ``a, b``."""

    def of(side: str, column: str) -> DataFrame:
        return sets.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"{column}_{side}"))

    if prune:
        sketched = pairs.join(of("a", "sketch"), "a").join(of("b", "sketch"), "b")
        pairs = sketched.mapInArrow(_close_sketches(rule), "a LONG, b LONG")
    full = pairs.join(of("a", "shingles").drop("n_a"), "a").join(of("b", "shingles").drop("n_b"), "b")
    return full.mapInArrow(_linked(rule), "a LONG, b LONG")


def _common(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted hashes ``x`` each of the others (not empty) holds."""
    flat = np.concatenate(others)
    place = np.searchsorted(x, flat)
    held = x[np.minimum(place, len(x) - 1)] == flat
    starts = np.cumsum([0, *(len(o) for o in others[:-1])])
    return np.add.reduceat(held, starts, dtype=np.int64)


def _block_links(rule: Rule):
    """Links between members of two blocks of a long list that are not connected yet.

    Sizes and sketches say which pairs are worth a comparison, and a pair that the links found so
    far connect is not compared: at most members - 1 rows leave the task.
    """

    def run(group: pa.Table) -> pa.Table:
        rid, n, component = (group.column(c).to_numpy() for c in ("rid", "n", "component"))
        own = group.column("own").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        # components that come in are trees of their own; links found here join them
        _, tree = np.unique(component, return_inverse=True)
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        a, b = [], []
        for x in left:
            y = right[tree[right] != tree[x]]
            both = n[y] + n[x]
            most = np.minimum((both - np.abs(sketch[y] - sketch[x]).sum(axis=1)) // 2, np.minimum(n[y], n[x]))
            y = y[100 * most >= rule.percent * (both - most)]
            for start in range(0, len(y), SHORT_LIST):
                some = y[start : start + SHORT_LIST]
                some = some[tree[some] != tree[x]]
                if not len(some):
                    continue
                common = _common(found[x], [found[i] for i in some])
                linked = some[100 * common >= rule.percent * (n[some] + n[x] - common)]
                for i in linked:
                    if tree[i] != tree[x]:
                        a.append(min(rid[i], rid[x]))
                        b.append(max(rid[i], rid[x]))
                        tree[tree == tree[i]] = tree[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


_MEMBER = ["key", "rid", "n", "alone", "component"]


def _open(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The members of the lists that hold several components of the links found so far.

    Their columns, and of the list: members and shingles (``_m``, ``_n``), the largest component
    ``_main`` and how many members are outside of it (``_out``).
    """
    found = connected_components(links)
    placed = lists.join(found, lists.rid == found.node, "left").withColumn("component", F.coalesce("component", "rid"))
    members = written(placed.select(_MEMBER), "members")
    per_component = members.groupBy("key", "component").agg(F.count("*").alias("_c"), F.sum("n").alias("_s"))
    sums = per_component.groupBy("key").agg(
        F.sum("_c").alias("_m"), F.sum("_s").alias("_n"), F.count("*").alias("_parts"),
        F.max(F.struct("_c", "component")).alias("_most"),
    )
    several = sums.where("_parts > 1").select(
        "key", "_m", "_n", F.col("_most.component").alias("_main"), (F.col("_m") - F.col("_most._c")).alias("_out")
    )
    return written(members.join(several, "key"), "open")


def _links_in(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of different components that share a list.

    Short lists are joined with themselves, which gives SHORT_LIST rows per member at most, and
    the pairs are checked.  Of long ones, the members outside the largest component are dealt into
    blocks, all members into others, and a block of the first kind meets every one of the second.
    """
    short, long = members.where(F.col("_m") <= SHORT_LIST), members.where(F.col("_m") > SHORT_LIST)
    other = short.select("key", *[F.col(c).alias(f"{c}_2") for c in ("rid", "n", "component")])
    met = short.join(other, "key").where(
        (F.col("rid") < F.col("rid_2")) & (F.col("component") != F.col("component_2"))
        & _sizes_fit(rule, F.col("n"), F.col("n_2"))
    ).select(F.col("rid").alias("a"), F.col("rid_2").alias("b"))
    checked = _checked(met.distinct(), sets, rule, prune=True)

    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    def number(count: str) -> Column:
        return F.pmod(F.xxhash64("rid"), F.col(count)).cast("int")

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    m, out = F.col("_m"), F.col("_out")
    dealt = long.withColumns({"_lefts": blocks(out, F.col("_n") * out / m), "_rights": blocks(m, F.col("_n"))})
    parts = ["key", "rid", "n", "component"]
    outside = dealt.where(F.col("component") != F.col("_main"))
    lefts = outside.select(*parts, number("_lefts").alias("i"), all_of("_rights").alias("j"), F.lit(True).alias("own"))
    rights = dealt.select(*parts, all_of("_lefts").alias("i"), number("_rights").alias("j"), F.lit(False).alias("own"))
    there = lefts.unionByName(rights).join(sets.select("rid", "sketch", "shingles"), "rid")
    found = there.groupBy("key", "i", "j").applyInArrow(_block_links(rule), "a LONG, b LONG")
    return checked.union(found)


def _pairs(near: DataFrame) -> DataFrame:
    """The pairs of sets and the most central of their leaders."""
    chosen = near.groupBy("rid").agg(F.min("lead").alias("lead"))
    return chosen.select(F.least("rid", "lead.rid").alias("a"), F.greatest("rid", "lead.rid").alias("b")).distinct()


def _other_leaders(members: DataFrame, rule: Rule) -> DataFrame:
    """For every set one ``a, b``: with the most central set of another component in its lists.

    A list names its most central member, and the most central one outside that one's component.
    """
    lead = F.struct("alone", "rid", "n", "component")
    first = members.groupBy("key").agg(F.min(lead).alias("one"))
    named = members.join(first, "key")
    second = named.where(F.col("component") != F.col("one.component")).groupBy("key").agg(F.min(lead).alias("two"))
    other = F.when(F.col("component") != F.col("one.component"), F.col("one")).otherwise(F.col("two"))
    return _pairs(named.join(second, "key").withColumn("lead", other).where(_sizes_fit(rule, F.col("n"), F.col("lead.n"))))


def _links(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links ``a, b`` that connect everything that any links connect.  ``sets``: one row per set."""
    entries = sets.select("rid", "n", "alone", F.explode("keys").alias("key"))
    # leaders are central: few of their shingles are in no other document
    rank = F.struct("alone", "rid", "n")
    shared = entries.groupBy("key").agg(F.count("*").alias("_c"), F.min(rank).alias("lead")).where("_c >= 2")
    lists = written(entries.join(shared, "key").select("key", "rid", "n", "alone", "lead"), "lists")
    near = lists.where(_sizes_fit(rule, F.col("n"), F.col("lead.n")) & (F.col("rid") != F.col("lead.rid")))
    links = written(_checked(_pairs(near), sets, rule, prune=False), "links")
    members = _open(lists.drop("lead"), links)
    for _ in range(MORE_LEADERS):
        links = links.union(written(_checked(_other_leaders(members, rule), sets, rule, prune=False), "links"))
        members = _open(members.select("key", "rid", "n", "alone"), links)
    return links.union(written(_links_in(members, sets, rule), "links"))


def similar_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs``.

    ``text_hash`` tells rows of the same id apart.
    """
    spark = docs.sparkSession
    ident = F.col(doc_id).cast("bigint")
    texts = docs.select(F.col(text).cast("string").alias("_text"))
    levels, length = shingle_levels(texts, rule.words)
    table = spark.sparkContext.broadcast(levels)
    boundary = light_boundary(rule, length)
    rows = docs.select(
        ident.alias("_id"), F.xxhash64(text).alias("_mark"), F.col(text).cast("string").alias("_text")
    )
    described = written(
        rows.mapInArrow(
            _described(rule, boundary, table),
            "_id LONG, _mark LONG, rid LONG, n LONG, alone LONG, s1 LONG, s2 LONG, keys ARRAY<LONG>, shingles BINARY, sketch BINARY",
        ),
        "sets",
    )
    table.destroy()  # the sets are written: nothing reads the levels again
    signature = ["s1", "s2", "n"]
    distinct_sets = written(
        described.where("n > 0").groupBy(*signature).agg(
            F.min("rid").alias("rid"), F.min("_id").alias("first_id"), F.count("*").alias("copies")
        ),
        "distinct",
    )
    holders = described.where("shingles is not null").select("rid", "n", "alone", "keys", "shingles", "sketch")
    sets = holders.join(distinct_sets.select("rid"), "rid", "left_semi")
    found = connected_components(_links(sets, rule))
    placed = distinct_sets.join(found, distinct_sets.rid == found.node, "left").select(
        *signature, "copies", "first_id", "component", F.coalesce("component", "rid").alias("_root")
    )
    linked = placed.where("component is not null")
    named = linked.groupBy("_root").agg(F.min("first_id").alias("component_id"))
    groups = linked.join(named, "_root").select(*signature, "component_id").unionByName(
        placed.where("component is null and copies > 1").select(*signature, F.col("first_id").alias("component_id"))
    )
    groups = written(groups, "groups")
    return described.select("_id", "_mark", *signature).join(groups, signature, "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_mark").alias("text_hash"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` without those of documents that link to one of a smaller id.

    All columns stay.  Repeated rows of one id and text stay or go together; a row without an id
    goes when its group has a document with one.
    """
    gone = similar_groups(docs, doc_id, text, rule).where(
        "component_id is not null and not (component_id <=> doc_id)"
    )
    gone = written(gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct(), "gone")
    return _without(docs, gone, doc_id, text)


def _without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the rows of ``gone`` (an id, which may be null, and a text hash).

    A table of 2^GONE_BITS bits, 64 in a row, says which rows are surely not in ``gone``: these
    stay where they are.  Only the others, which are the ones to go and a few by chance, are
    shuffled and compared.  The table has 2^(GONE_BITS - 6) rows at most, whatever the input; when
    it fills, more rows are shuffled and the result stays the same.
    """
    own = [f"d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    slot = f"pmod(xxhash64(_gone_id, _gone_text), {1 << GONE_BITS}L)"
    bit = "shiftleft(1L, cast(_slot & 63 as int))"
    slots = gone.selectExpr(f"{slot} as _slot")
    words = written(slots.groupBy(F.expr("_slot >> 6").alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits")), "bits")
    marked = docs.toDF(*own).withColumns(
        {"_gone_id": F.col(at[doc_id]).cast("bigint"), "_gone_text": F.xxhash64(at[text])}
    ).withColumn("_slot", F.expr(slot)).withColumn("_word", F.expr("_slot >> 6"))
    met = marked.join(F.broadcast(words), "_word", "left").withColumn(
        "_maybe", F.expr(f"coalesce(_bits & {bit}, 0L) <> 0")
    ).select(*own, "_gone_id", "_gone_text", "_maybe")
    other = gone.toDF("_id", "_text").hint("merge")  # the same plan at every size
    same = F.col("_gone_id").eqNullSafe(F.col("_id")) & (F.col("_gone_text") == F.col("_text"))
    stayed = met.where("not _maybe").select(*own)
    compared = met.where("_maybe").join(other, same, "left_anti").select(*own)
    return stayed.unionAll(compared).toDF(*docs.columns)
