"""Training-data operators on small tables with nulls, empty and long texts, repeated rows and names that clash."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from encircle.llm import (
    decontaminate, license_scan, line_chunks, mixing, ngram_join, page_text, quality, sharding, url_filter, warc,
)
from encircle.llm.queries import QUERIES
from encircle.llm.components import connected_components
from encircle.llm.shared import word_count
from encircle.session import scratch_path

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(4000)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [sentence(n) for n in (5, 12, 30, 60, 200, 400, 90, 3)]
    near = [b.replace(b.split()[1], "other", 1) for b in base]
    copies = [base[4]] * 40 + [base[4].replace(f" {w} ", f" x{i} ", 1) for i, w in enumerate(base[4].split()[2:90:3])]
    odd = [None, "", " \n\t", "one", "One two", sentence(20_000), "a\x85b c\x0bd", "Ünïcode 漢字 text " * 8]
    return base + near + copies + odd + [base[5] + " " + sentence(n) for n in (20, 60, 100, 160)]


def docs_of(spark, texts, ids=None):
    """``n``, ``size``, ``shard`` and the like clash with the operators' own columns."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, 1, 2, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, size INT, shard INT, n_words STRING"
    return spark.createDataFrame(rows, schema)


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_similar_groups_equal_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs_of(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets)))}


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = sentence(60).split()
    family = []
    for _ in range(60):
        changed = list(base)
        for _ in range(RNG.randint(0, 4)):
            changed[RNG.randrange(60)] = RNG.choice(WORDS)
        family.append(" ".join(changed))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs_of(spark, family)).collect()}
    assert got == dict(enumerate(components([shingle_set(t) for t in family])))


def test_one_long_list_of_families(spark, monkeypatch):
    """1,200 texts share a passage, so they meet in long lists; most are too different to link."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    passage = sentence(40).split()
    tails = [sentence(9).split() for _ in range(60)]
    texts = []
    for i in range(1200):
        tail = list(tails[i % 60]) if i % 3 else sentence(14).split()
        if i % 4 == 1:
            tail[RNG.randrange(9)] = RNG.choice(WORDS)
        texts.append(" ".join(passage[i % 7:] + tail))
    sets = [shingle_set(t) for t in texts]
    links, compared = [], ngram_join._links

    def kept(*given):
        links.append(compared(*given))
        return links[-1]

    monkeypatch.setattr(ngram_join, "_links", kept)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(components(sets)))
    assert 1 < len(set(got.values())) < 1200
    assert links[0].count() < 6 * 1200  # two rounds of leaders and forests, no pairs


def test_keep_one_keeps_columns_and_repeated_rows(spark):
    text = sentence(40)
    docs = docs_of(spark, [text, text, text, None, "", text], [3, 5, 3, 8, 9, None])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 3, 8, 9]


@pytest.mark.parametrize("bits", [6, 27])
def test_without_is_exact_when_the_bits_are_full(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "GONE_BITS", bits)
    texts = [f"t{i % 300}" if i % 50 else None for i in range(600)]
    ids = [None if i % 40 == 0 else i for i in range(600)]
    docs = docs_of(spark, texts, ids).withColumnsRenamed({"size": "_slot", "shard": "d0"})
    gone = docs.where("_slot = 1 and (doc_id % 3 = 0 or doc_id is null)").select(
        F.col("doc_id"), F.xxhash64("text")
    ).distinct()
    want = [i for i in ids if i is not None and i % 3]
    kept = ngram_join._without(docs, gone.toDF("_gone_id", "_gone_text"), "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    none = ngram_join._without(docs, gone.limit(0).toDF("_gone_id", "_gone_text"), "doc_id", "text")
    assert none.count() == 600


def test_boundary_grows_with_list_length():
    rule = ngram_join.Rule()
    assert 1 <= ngram_join.light_boundary(rule, 2.0) < ngram_join.light_boundary(rule, 10.0)


def test_components_of_chain_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, None)], "a BIGINT, b BIGINT")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100}
    assert connected_components(edges.limit(0)).isEmpty()


@pytest.mark.parametrize("block_chars", [32 << 20, 400])
def test_contamination_equals_brute_force(spark, texts, block_chars):
    items = [(1, texts[3]), (2, "Short item"), (10, texts[4]), (3, None), (4, ""), (1, texts[2]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    inside = texts + ["pre " + " ".join(texts[3].split()[5:18]) + " post", "a SHORT item, short ITEM", texts[4].upper()]
    found = decontaminate.contamination(docs_of(spark, inside), bench, block_chars=block_chars)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    windows = {}
    for item, text in items:
        w = decontaminate.words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    for i, text in enumerate(inside):
        w, hit, held = decontaminate.words_of(text), set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    held |= windows[tuple(w[p : p + m])]
        assert got[i] == (len(w), len(hit), sorted(held))
    clean = decontaminate.clean(docs_of(spark, inside), bench)
    assert clean.columns == docs_of(spark, []).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, v in got.items() if v[1] == 0}


def test_base_counts():
    w = ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert quality.repeated_words([x.encode() for x in w + w]) == 16
    assert quality.repeated_words([x.encode() for x in w + ["z"] + w[:7]]) == 0
    assert quality.repeated_words([b"a"] * 9) == 9
    text = "x # y\nx # y\n\n*|\n"
    assert quality.base_counts(text)[1] == (7, 8, 4, 1, 0)
    many = [RNG.choice("ab").encode() for _ in range(300)]
    seen = {}
    for i in range(len(many) - 7):
        seen.setdefault(tuple(many[i : i + 8]), []).append(i)
    marked = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    assert quality.repeated_words(many) == len(marked)


def test_quartiles_are_exact_whatever_the_partitions(spark):
    import math

    rng = random.Random(3)
    keys = ["en 5", "en 6", "script han 5"]
    rows = [(rng.choice(keys), *(rng.choice([0.25, 1.5, rng.random() * 9, 5000.0]) for _ in range(4))) for _ in range(900)]
    names = ["chars_per_token", "tokens_per_word", "byte_share", "token_entropy"]
    frame = spark.createDataFrame(rows, f"band_key STRING, {', '.join(n + ' DOUBLE' for n in names)}")
    groups = {}
    for key, *values in rows:
        for k in (key, key.rsplit(" ", 1)[0], ""):
            groups.setdefault(k, []).append(values)
    want = {}
    for key, members in groups.items():
        for i, name in enumerate(names):
            ordered = sorted(math.floor(min(m[i], 1000.0) * 1000 + 0.5) / 1000 for m in members)
            want[key, name] = [ordered[-(-len(ordered) * q // 4) - 1] for q in (1, 2, 3)]
    for n in (1, 3, 17):
        found = quality.quartiles(frame.repartition(n)).collect()
        assert {r.band_key: r._n for r in found} == {k: len(m) for k, m in groups.items()}
        assert {(r.band_key, name): list(r[name]) for r in found for name in names} == want
    assert quality.quartiles(frame.limit(0)).count() == 0


def test_quality_rejects_only_what_lies_outside_the_bands(spark):
    good = [sentence(80) for _ in range(120)]
    bad = ["%%% &&& " + " ".join(w + "&&&" for w in sentence(78).split()), "zz " * 80, None, "", "short text"]
    docs = docs_of(spark, good + bad)
    judged = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(judged[i].kept for i in range(120))
    assert not any(judged[i].kept for i in range(120, 125))
    assert judged[122].n_words == judged[122].word_chars == 0 and judged[122].base_failed
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(120))
    assert quality.quality(docs.limit(0)).isEmpty()


def test_small_groups_are_judged_by_their_language_or_the_corpus(spark):
    # 40 documents of each length class, and one of a rare language
    good = [sentence(n) for n in (40, 80, 160) for _ in range(40)]
    junk = [" ".join("&%" + w + "~^" for w in sentence(n).split()) for n in (80, 2000)]
    rows = [(i, t, "en") for i, t in enumerate(good + junk)] + [(200, junk[0], "fi"), (201, good[0], "fi")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert kept == set(range(120)) | {201}
    assert {r.doc_id for r in quality.keep_good(docs.where("doc_id < 5")).collect()} == set(range(5))


def test_mixture_meets_targets(spark):
    rows = [(i, sentence(RNG.randint(0, 60)), "big" if i % 3 == 0 else [None, "a", "b", "c"][i % 4]) for i in range(600)]
    rows += [(0, rows[0][1], "big"), (None, None, "a"), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
    mixture = mixing.mix(sized, "source", "size", "mark", shards=6, blocks=16).toPandas()
    assert len(mixture) == len(rows)
    sources = mixture.groupby("source", dropna=False).agg(
        size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")
    ).sort_index()
    assert (sources["size"] == sources.whole).all()
    names = ["a", "b", "big", "c", None]  # by code point, null last
    weights = dict(zip(names, (1, 2, 3, 1, 2)))
    total, free, targets = sources.whole.sum(), set(names), {}
    size = {None if isinstance(k, float) else k: v for k, v in sources.whole.items()}
    while True:
        rest = total - sum(targets.values())
        share = {n: rest * weights[n] / sum(weights[x] for x in free) for n in free}
        over = [n for n in free if share[n] > 3 * size[n]]
        if not over:
            break
        targets |= {n: 3 * size[n] for n in over}
        free -= set(over)
    targets |= share
    for name, row in sources.iterrows():
        name = None if isinstance(name, float) else name
        assert row.target == pytest.approx(targets[name])
        assert abs(row.taken - row.target) <= 40
    assert (mixture.taken <= 3 * mixture["size"]).all()
    drawn = mixing.mixed_rows(mixing.mix(sized, "source", "size", "mark", shards=6, blocks=16))
    assert drawn.agg(F.sum("size")).first()[0] == mixture.taken.sum()
    assert {r["shard"] for r in drawn.select("shard").distinct().collect()} <= set(range(6))
    assert mixing.mix(sized.limit(0), "source", "size", "mark").isEmpty()


def test_mixture_shows_its_shards_and_their_order(spark, tmp_path):
    docs_of(spark, [sentence(20) for _ in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_source_mixing"](spark, str(tmp_path)).collect()
    for r in rows:
        draws = r.taken // r.size
        assert len(r.draw_shards.split(",")) == len(r.draw_places.split(",")) == draws if draws else r.draw_shards == ""
    assert len({s for r in rows for s in r.draw_shards.split(",") if s}) > 1
    order = {}
    for r in rows:
        for s, p in zip(r.draw_shards.split(","), r.draw_places.split(",")):
            if s:
                order.setdefault((int(s), int(p) % 64), []).append((int(p), r.doc_id))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = dict(corpus_pipeline.STAGES)["mixture"](spark, docs, str(tmp_path))
    parts = mixed.select("doc_id", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.doc_id for r in parts) == sorted(d for group in order.values() for _, d in group)
    where = {}
    for at, r in enumerate(parts):
        where.setdefault(r.doc_id, []).append(at)
    one = [[d for _, d in sorted(group) if len(where[d]) == 1] for group in order.values()]
    assert all(where[a] < where[b] for group in one for a, b in zip(group, group[1:]))


def test_split_keeps_quotas(spark):
    quotas = spark.createDataFrame([(i, q) for i, q in enumerate([50, 1, 0, 33, 70])], "ordinal BIGINT, quota INT")
    parts = mixing._split(quotas, 8, 1).toPandas()
    assert parts.groupby("ordinal").quota.sum().to_dict() == {0: 50, 1: 1, 3: 33, 4: 70}
    sizes = parts.groupby("shard").quota.sum()
    assert sizes.max() - sizes.min() <= 3 and len(sizes) == 8


def sharded(spark, docs, shards=4):
    sized = docs.select("doc_id", "text", sharding.text_size("text").alias("bytes"), sharding.text_digest("text").alias("digest"))
    return sharding.shard(sized, "doc_id", "bytes", "digest", shards).toPandas()


def test_shards_hold_whole_groups_near_equally(spark, texts):
    found = sharded(spark, docs_of(spark, texts + texts[:5] + [sentence(30) for _ in range(300)]))
    filled = found.fillna({"text": ""})
    assert (filled.groupby("text").shard.nunique() == 1).all()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = filled.groupby("digest").bytes.sum()
    order = groups.sort_index()

    def enough(capacity):
        used, now = 1, 0
        for size in order:
            if size > capacity:
                return False
            if now + size > capacity:
                used, now = used + 1, 0
            now += size
        return used <= 4

    smallest = next(c for c in range(order.max(), order.sum() + 1) if enough(c))
    assert found.groupby("shard").bytes.sum().max() <= smallest


def test_shards_of_few_groups_and_none(spark):
    found = sharded(spark, docs_of(spark, ["a"] * 9 + [None, "b"], [1] * 9 + [None, 2]))
    assert len(found) == 11 and sorted(found[found.text == "a"].slot)[-1] - min(found[found.text == "a"].slot) == 8
    assert sharded(spark, docs_of(spark, [])).empty


def test_url_rules_and_templates(spark):
    urls = ["http://A.example.com/en/1", "http://www.example.com/en/x?q", "http://x.net/es/1", "ftp://u@h.net:80/fr/a#b", "no scheme", None, "http://com", "HTTP://example.com/en", "x://y://z/w", ""]
    pages = [(i, u) for i, u in enumerate(urls)]
    pages += [(100 + i, f"http://s.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(100, "http://s.org/news/0"), (None, "http://s.org/q")]
    frame = spark.createDataFrame(pages, "page_id BIGINT, url STRING")
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1, 0) for i in range(160)] + [(100, None, None), (None, 0, 1)], "doc_id BIGINT, quality INT, toxic INT")
    rows = url_filter.judge_urls(frame, labels).collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r for r in rows}
    assert [(by[i].host, by[i].path, by[i]["rule"]) for i in range(10)] == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/x", "www.example.com/en/"),
        ("x.net", "/es/1", "net/es/"), ("u@h.net:80", "/fr/a", None), ("", "", None), ("", "", None), ("com", "", None),
        ("example.com", "/en", "com/"), ("y:", "//z/w", None), ("", "", None),
    ]
    assert {(by[100 + i].template, by[100 + i].verdict) for i in range(200)} == {("/news/*", "allow"), ("/spam/*", "block")}
    assert url_filter.judge_urls(frame.limit(0), labels.limit(0)).isEmpty()


def test_small_and_deep_bad_sections_are_found(spark):
    """Sections of 5 to 19 labelled pages, one six segments deep, similar ones in one branch."""
    urls, bad = [], {}
    for host, section, n, share in (
        ("a", "/spam", 5, 1.0), ("a", "/casino7", 6, 1.0), ("a", "/news", 60, 0.05),
        ("b", "/u/v/w/x/y/bad", 19, 1.0), ("b", "/u/v/w/x/y/good", 40, 0.0), ("b", "/u/v/w/x/y/fine", 40, 0.0),
        ("c", "/x", 30, 0.1), ("c", "/y", 30, 0.1),
    ):
        for k in range(n):
            bad[len(urls)] = int(k < n * share)
            urls.append(f"http://{host}/{section[1:]}/{1000 + len(urls)}")
    urls += [f"http://a/{i}/page" for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id BIGINT, quality INT, toxic INT")
    by = {r.url: r for r in url_filter.judge_urls(frame, labels).collect()}
    found = {(r.host, r.template, r.verdict) for r in by.values()}
    assert {t for h, t, v in found if h == "a" and v == "block"} == {"/{casino7}/*"}
    assert ("b", "/u/v/w/x/y/bad/*", "block") in found and not any(h == "b" and v == "block" for h, t, v in found if "bad" not in t)
    assert {t for h, t, v in found if h == "c"} == {"/*/*"}  # not told apart
    assert all(by[url].verdict == ("block" if "/spam/" in url or "/casino7/" in url or "/bad/" in url else "allow") for url in urls)


def test_trees_do_not_depend_on_partitions(spark):
    urls = [f"http://h{RNG.randrange(3)}/{RNG.choice('abcd')}/{RNG.choice(['x', 'y', '12', ''])}/{i % 9}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate([*urls, None, "x://", "h/a"])), "page_id BIGINT, url STRING")
    labels = spark.createDataFrame([(i, int("/a/" not in u and i % 5 > 0), 0) for i, u in enumerate(urls) if i % 2], "doc_id BIGINT, quality INT, toxic INT")
    runs = [sorted(map(tuple, url_filter.judge_urls(frame.repartition(n), labels.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 303


@pytest.mark.parametrize("bits", [6, 9, 24])
def test_archives_when_the_bits_are_full(spark, monkeypatch, bits):
    monkeypatch.setattr(warc, "BIT_TABLE", bits)
    rows = [(None if i % 97 == 0 else i // 2 * 2, f"http://h/{i}", f"text {i % 400}" if i % 3 else f"own {i}") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    first, count = {}, {}
    for page, _, text in rows:
        count[text] = count.get(text, 0) + 1
        if page is not None:
            first[text] = min(first.get(text, page), page)
    want = sorted((str(page), "response" if count[text] == 1 or page == first.get(text) else "revisit") for page, _, text in rows)
    got = warc.archive_records(pages).select("page_id", "record_type", "record").collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == want
    assert all(r.record.endswith("\r\n\r\n") == (r.record_type == "revisit") for r in got)
    plan = warc.archive_records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_archives_round_trip(spark):
    odd = ["a\r\n\r\nb\r\n", "", None, "x", "\r\n", "line\nline\r", "é" * 3000, "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc"]
    pages = [(i, f"http://h/{i}\n?", h) for i, h in enumerate(odd + odd + ["x"] * 5)] + [(0, "http://h/0", odd[0]), (None, None, "x"), (99, None, "alone")]
    frame = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")
    for least in (0, 2):
        path = scratch_path(spark, "warc")
        warc.write_archives(frame, path, least)
        got = sorted((tuple(r) for r in warc.resolved(warc.read_archives(spark, path)).select("page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload").collect()), key=str)
        want = []
        for page, _, source in pages:
            data = (source or "").encode()
            first = min(p for p, _, s in pages if (s or "") == (source or "") and p is not None)
            again = len(data) >= least and page != first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((page, "revisit" if again else "response", digest, len(data), first if again else None, data.decode()))
        assert got == sorted(want, key=str)
    path = scratch_path(spark, "warc")
    warc.write_archives(frame.limit(0), path)
    assert warc.read_archives(spark, path).isEmpty()


PAGE = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav>"
    "<div class=\"cookie-notice\">We use cookies</div>{body}<form>Mail <input></form><footer>&copy; me</footer></body></html>"
)


def text_of(page, neighbour=None):
    other = page_text.page_lines(neighbour) if neighbour else None
    return page_text.main_text(page_text.page_lines(page), other)


def test_main_text():
    body = "<aside>No</aside><article><header><h1>A &amp; B</h1></header><p>One\n <b>two<br>three<p>Four&nbsp;4 &lt;x&gt;<div class='ad'>buy</div><ul><li>i<li>j</ul></article><section id=comments><p>Nice!</p></section>"
    assert text_of(PAGE.format(body=body)) == "A & B\nOne two three\nFour 4 <x>\ni\nj"
    assert text_of("<article><p>cut off</p><p>last</p") == "cut off\nlast"
    assert text_of("1 < 2 and text") == "1 < 2 and text"
    assert text_of(None) == text_of("") == text_of("<p> </p><!-- x -->") == ""
    assert len(text_of("<article>" + "<p>x</p>" * 50_000)) == 99_999


def test_shared_lines_go_where_no_article_is_marked(spark):
    frame = "<p>Our site</p><p>{}</p><p>{}</p><p>Imprint</p>"
    one, two = frame.format(sentence(20), sentence(20)), frame.format(sentence(20), sentence(20))
    assert "Our site" not in text_of(one, two) and text_of(one, two).count("\n") == 1
    assert text_of(one, one).count("\n") == 3
    rows = [(1, "http://h/a/1", one), (2, "http://h/a/2", two), (3, "http://other/a", one), (4, None, None), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1)
    got = {r.page_id: r for r in page_text.extract_text(pages).collect()}
    assert got[4].text == "" and got[4].n_chars == 0 and got[3].text.startswith("Our site")
    assert page_text.extract_text(pages.limit(0)).isEmpty()


def test_shared_runs_go_inside_an_article():
    frame = "<article><div class='x1'><p>Home</p><p>Shop</p></div><p>{}</p><p>See also</p><p>{}</p><div>Tell a friend</div><div>Print</div></article>"
    one, two = [sentence(20), sentence(20)], [sentence(20), sentence(20)]
    # the article vouches for the single line
    assert text_of(frame.format(*one), frame.format(*two)) == "\n".join([one[0], "See also", one[1]])


def test_an_article_keeps_heading_first_and_last_lines():
    """Whatever the lines beside it, also those of the frame: only whole boxes of an article go."""
    frame = (
        "<div>Menu line</div><article><h1>{0}</h1><p>Opening</p><div><p>{1}</p><p>Shared words</p></div>"
        "<div><h1>Title</h1></div><ul><li>Share</li><li>Print</li></ul><p>Closing</p></article><div>Imprint</div>"
    )
    one, two = frame.format("Same", sentence(20)), frame.format("Same", sentence(20))
    text = text_of(one, two)
    assert text.split("\n")[:2] == ["Same", "Opening"] and text.split("\n")[-1] == "Closing"
    assert "Share\nPrint" not in text and "Shared words" in text and "Title" in text and "Menu" not in text
    # a box with most of the text stays even if all of it is shared
    short = "<article><p>{}</p><div><p>" + sentence(30) + "</p></div></article>"
    longer = short.format("b " * 900)
    assert text_of(short.format("a"), longer).count("\n") == 1


def test_copies_look_for_a_page_that_differs(spark, monkeypatch):
    frame = "<{0}><p>Home</p><p>Shop</p><p>{1}</p><p>{2}</p></{0}>"
    own, other = [sentence(30), sentence(10)], [sentence(30), sentence(10)]
    short = "<p>" + "</p><p>".join(["A long notice " * 9, "Second notice " * 9]) + "</p><p>{}</p>"
    pages = [(i, f"http://h/a/{i}", frame.format("article", *own)) for i in range(3)]
    pages += [(3, "http://h/a/3", frame.format("article", own[0], "changed")), (4, "http://h/b", frame.format("article", *other)), (5, "http://h/c", None)]
    pages += [(10 + i, f"http://g/{i}", short.format(f"Own text {i}")) for i in range(3)]
    pages += [(20 + i, f"http://k/{i}", frame.format("main", own[0], f"end {i}")) for i in range(2)]
    table = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").coalesce(1)
    want = {i: "\n".join(own) for i in range(3)} | {3: own[0] + "\nchanged", 4: "\n".join(other), 5: ""}
    want |= {10 + i: f"Own text {i}" for i in range(3)}
    want |= {20 + i: f"Home\nShop\n{own[0]}\nend {i}" for i in range(2)}  # nothing but near copies
    assert {r.page_id: r.text for r in page_text.extract_text(table).collect()} == want
    arrow = [(i, u, u.split("/")[2], "/" + u.split("/", 3)[3], h) for i, u, h in sorted(pages, key=lambda p: p[1].split("/")[2:])]
    batch = page_text.pa.RecordBatch.from_arrays([page_text.pa.array(c) for c in zip(*arrow)], list("iuhps"))
    monkeypatch.setattr(page_text, "BATCH_CHARS", 30)  # waiting pages go through the file
    got = [r for b in page_text._extracted([batch]) for r in b.to_pylist()]
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(pages)


def test_common_lines():
    assert page_text.common_lines(list("abcabd"), list("xabdab")) == {0, 1, 3, 4}
    assert page_text.common_lines([], ["a"]) == set()


def test_line_chunks(spark):
    common = "\n".join(f"shared line {i} {sentence(3)}" for i in range(40))
    texts = [sentence(5) + "\n" + common, common, "\n".join(sentence(4) for _ in range(3)) + "\n" + common, None, "", "one", "a\n" * 30]
    docs = docs_of(spark, texts + [texts[1]], list(range(len(texts))) + [1])
    found = line_chunks.dedup_lines(docs)
    assert found.columns == docs.columns + ["n_lines", "n_removed"]
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(texts) + 1
    assert got[0].text == texts[0] and got[0].n_removed == 0
    for i in (1, 2):
        assert got[i].n_removed == 40 and got[i].n_lines == texts[i].count("\n") + 1
        kept = got[i].text.split("\n") if got[i].text else []
        assert len(kept) == got[i].n_lines - got[i].n_removed or not kept
    assert got[3].text is None and got[3].n_lines == 0
    assert (got[4].text, got[4].n_lines, got[5].text) == ("", 1, "one")
    assert line_chunks.dedup_lines(docs.limit(0)).isEmpty()


def lines_left(docs):
    """Lines that stay, pair by pair: ``docs`` are distinct ``(id, text)`` in the order of places."""
    pairs, seen = [], {}
    for d, (_, text) in enumerate(docs):
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
        pairs += [(d, i, j, "\n".join(lines[i : j + 1])) for i, j in zip(filled, filled[1:])]
    count = {}
    for *_, chunk in pairs:
        count[chunk] = count.get(chunk, 0) + 1
    gone, lead = set(), set()
    for d, i, j, chunk in pairs:
        if count[chunk] > 1:
            first = seen.setdefault(chunk, (d, i)) == (d, i)
            (lead if first else gone).update((d, x) for x in range(i, j + 1))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone - lead) for d, (_, t) in enumerate(docs)]


def test_short_passages_are_found_whole(spark):
    """Passages of 2 to 6 lines between lines of their own, over themselves, with blank lines, cut short."""
    passages = [[sentence(6) for _ in range(n)] for n in (2, 2, 3, 4, 5, 6)]
    passages += [["a", "", "b"], ["x", "x", "x", "x"], ["c", " \t", "", "d", "e"], ["", "", ""]]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(RNG.randint(1, 4)):
            passage = RNG.choice(passages)
            lines += [sentence(5)] * RNG.randint(0, 1) + passage[RNG.randint(0, 1):]
        texts.append("\n".join(lines))
    texts = list(dict.fromkeys(texts))
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs_of(spark, texts)).collect()}
    want = lines_left(list(enumerate(texts)))
    assert [got[i].text for i in range(len(texts))] == want
    for passage in passages[:6]:  # none stays twice, and no line is lost
        whole = "\n".join(passage)
        assert sum(whole in text for text in texts) > 3 and sum(whole in text for text in want) <= 1
        assert all(any(line in text.split("\n") for text in want) for line in passage)
    assert all(got[i].n_lines - got[i].n_removed == len(w.split("\n")) for i, w in enumerate(want) if w)


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    texts = [
        "Some text. " + mit + " more text", mit.replace("free of charge", "without charge"), "Permission is hereby granted",
        "released UNDER the mit licence. Released under the MIT License.", None, "", sentence(3000) + " " + license_scan.TEMPLATES["GPL-3.0"],
        "Licensed under CC BY-NC 4.0. " * 3,
    ]
    got = {r.doc_id: [(m.license, m.first, m.past, m.coverage) for m in r.matches] for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    n = len(mit.split())
    assert got[0] == [("MIT-text", 2, 2 + n, 1.0)]
    assert got[1][0][0] == "MIT-text" and 0.9 <= got[1][0][3] < 1
    assert got[2] == [] and got[4] == [] and got[5] == []
    assert [m[0] for m in got[3]][-1] == "MIT" and got[3][-1][3] == 1.0
    assert got[6] == [("GPL-3.0", 3000, 3012, 1.0)]
    assert [m[0] for m in got[7]] == ["CC-BY-NC-4.0"] * 3
    assert license_scan.scan_licenses(docs_of(spark, [])).isEmpty()


def test_license_scan_tries_every_diagonal_outside_the_band(spark):
    line = license_scan.TEMPLATES["GPL-3.0"]
    bsd = license_scan.read_templates()["BSD-3-Clause-full"].split()
    texts = ["This work is licensed. " + line, "Released under the. " + license_scan.TEMPLATES["MIT"], " ".join(bsd[20:])]
    got = {r.doc_id: [(m.license, m.coverage) for m in r.matches] for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert got[0] == [("GPL-3.0", 1.0)] and got[1] == [("MIT", 1.0)]
    assert [m[0] for m in got[2]] == ["BSD-3-Clause-full"] and got[2][0][1] > 0.9


def test_license_scan_knows_whole_texts(spark, tmp_path):
    shipped = license_scan.read_templates()
    names = sorted(shipped)
    altered = []
    for name in names:
        changed = shipped[name].split()
        for i in range(10, len(changed), 25):
            changed[i] = "altered"
        changed[len(changed) // 2 : len(changed) // 2] = ["one", "inserted"]
        altered.append(sentence(30) + " " + " ".join(changed) + " " + sentence(5))
    found = license_scan.scan_licenses(docs_of(spark, altered)).collect()
    best = {r.doc_id: max(r.matches, key=lambda m: m.matched) for r in found}
    assert [best[i].license for i in range(len(names))] == names
    assert all(m.coverage >= 0.85 and m.first >= 30 for m in best.values())
    assert all(sum(m.license.endswith("-header") for m in r.matches) <= 1 for r in found)
    (tmp_path / "Own-1.0.txt").write_text("Do with this whatever you like but tell us about it")
    own = license_scan.read_templates(tmp_path)
    rows = license_scan.scan_licenses(docs_of(spark, ["Well: do with this whatever you like, but tell us about it."]), templates=own)
    assert [m.license for m in rows.first().matches] == ["Own-1.0"]


def test_pipeline_equals_its_operators(spark, tmp_path, texts):
    good = [sentence(60) for _ in range(80)]
    item = " ".join(good[5].split()[10:30])
    all_texts = good + [good[1], good[2] + " more", None, "", "junk"]
    docs_of(spark, all_texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "size", "n_words", "shard", "slot"]
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert ids <= set(range(80)) - {5}
    assert max(sum(r.doc_id == i for r in rows) for i in ids) <= 3
    for s in {r["shard"] for r in rows}:
        slots = sorted(r.slot for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages["quality"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(82))
    single = stages["near_duplicates"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == set(range(80))
    clean = stages["decontamination"](spark, single, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == set(range(80)) - {5}
    for stage in (kept, single, clean, stages["mixture"](spark, clean, str(tmp_path))):
        assert stage.columns == docs.columns
