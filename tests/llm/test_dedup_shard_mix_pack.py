import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from rastrella.llm import exact_dedup, mixing, packing, sharding, simhash, toxicity
from rastrella.llm.common import spread_rank
from rastrella.llm.graph import components
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


# exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort_matches_brute_force(hard_docs, keep):
    got = exact_dedup.content_sort(hard_docs, keep=keep).collect()
    groups = defaultdict(list)
    for r in hard_docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(got) == hard_docs.count()
    stays = Counter()
    for r in got:
        ids = groups[r["text"] or ""]
        named = [i for i in ids if i is not None]
        assert r["keep_id"] == ((min if keep == "smallest" else max)(named) if named else None)
        assert r["group_size"] == len(ids)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            stays[r["text"] or ""] += 1
    assert stays == Counter(dict.fromkeys(groups, 1))


def test_content_sort_hot_group(spark):
    rows = [(i, "same") for i in range(300)] + [(1000 + i, f"text {i % 90}") for i in range(100)] + [(299, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep, best in (("largest", 299), ("smallest", 0)):
        got = exact_dedup.content_sort(docs, keep=keep).collect()
        same = [r for r in got if r["text"] == "same"]
        assert {(r["keep_id"], r["group_size"]) for r in same} == {(best, 301)}
        assert [r["doc_id"] for r in same if r["kept"]] == [best]
        assert sum(r["kept"] for r in got) == 91 and len(got) == 401


def test_content_sort_has_no_python_and_takes_empty_tables(hard_docs, no_docs):
    plan = exact_dedup.content_sort(hard_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert exact_dedup.content_sort(no_docs).count() == 0


# SimHash


def slow_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("words", [3, 5])
def test_fingerprints(hard_docs, words):
    for r in hard_docs.collect():
        assert simhash.fingerprint(None if r["text"] is None else r["text"].encode(), words) == slow_fingerprint(r["text"], words)


def test_ring_keys_are_complete(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        pairs.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.filter(F.arrays_overlap(F.array(*simhash.ring_keys("a")), F.array(*simhash.ring_keys("b")))).count() == len(pairs)


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 3])
def test_near_duplicates_match_brute_force(spark, hot):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, 3, hot_bucket=hot).collect()}
    prints = {r["doc_id"]: slow_fingerprint(r["text"], 3) for r in docs.collect()}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union_find(prints, linked)
    assert {d: r["fp"] & (1 << 64) - 1 for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == want


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 20])
def test_dense_clusters_link_exactly(spark, hot):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    values = set(seeds)
    for s in seeds:
        for _ in range(80):
            v = s
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    want = union_find(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3])
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    if hot == 20:
        edges = simhash.hot_links(nodes)
    else:
        keyed = nodes.select("fp", F.explode(F.array(*simhash.ring_keys())).alias("key")).select("key", "fp")
        edges = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(simhash._link_sorted, "u long, v long")
        assert edges.count() < 16 * len(values)
    got = union_find(values, [(r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in edges.collect()])
    assert len(set(got.values())) == len(set(want.values())) and all(got[a] == got[want[a]] for a in values)


def test_near_duplicates_of_hard_rows(hard_docs, no_docs):
    rows = simhash.near_duplicates(hard_docs, 5).collect()
    assert len(rows) == hard_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[3] == by[2] == by[1] == {1} and by[5] == by[6] == by[4] == {4}
    assert simhash.near_duplicates(no_docs, 5).count() == 0
    kept = simhash.drop_near_duplicates(hard_docs, 5, None)
    assert kept.columns == hard_docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 9, None}


def slow_shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


@pytest.mark.parametrize(("hot", "block"), [(simhash.HOT_KEY, simhash.BLOCK), (8, 7), (1, 50)])
def test_similar_documents_match_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 4000").select("doc_id", "text").collect()]
    line = " ".join(f"common{i}" for i in range(30))
    base = [f"b{i}" for i in range(70)]
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(70), rng.randint(0, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((10**6 + i, " ".join(words)))
        rows.append((2 * 10**6 + i, f"{line} own{i} tail{i % 7}"))
        rows.append((3 * 10**6 + i, f"{line} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))))
    sets = {d: slow_shingles(t) for d, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), hot_bucket=hot).collect()}
    assert got == union_find(sets, linked)


def test_ring_never_loses_a_pair_within_the_budget():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 40, (20_000, simhash.SEGMENTS))
    most = rng.integers(60, 160, len(a))
    passed = simhash.ring_pass(a, most)
    assert passed[a.sum(axis=1) <= most].all() and not passed.all()


def test_near_copy_recall(spark):
    """Of the pairs of different texts with a similarity of 0.8 that a plain join on all shingles finds, all share a component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    roots = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    rows = docs.collect()
    sets = {r["doc_id"]: frozenset(simhash.shingles((r["text"] or "").encode(), 5).tolist()) for r in rows}
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d], d)
    holders = defaultdict(list)
    for s, d in least.items():
        for g in s:
            holders[g].append(d)
    pairs, by_id = set(), {d: s for s, d in least.items()}
    for found in holders.values():
        if 1 < len(found) <= 50:
            pairs.update(itertools.combinations(found, 2))
    near = [(a, b) for a, b in pairs if 9 * len(by_id[a] & by_id[b]) >= 4 * (len(by_id[a]) + len(by_id[b]))]
    assert len(near) > 40 and all(roots[a] == roots[b] for a, b in near)


def test_pipeline_drops_near_copies_beyond_three_bits(spark):
    words = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:57], "other", *words[58:]])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    prints = [slow_fingerprint(r["text"], 5) for r in docs.collect()]
    assert (prints[0] ^ prints[1]).bit_count() > 3
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7001), (7001, 7000), (7002, 7002)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 7002}


# sharding


def test_best_fit_decreasing_matches_plain_form():
    rng = random.Random(3)
    for bins in (4, None):
        for _ in range(40):
            sizes = Counter(rng.randint(1, 40) for _ in range(120))
            capacity = 60 if bins is None else -(-sum(s * n for s, n in sizes.items()) // bins)
            got = Counter()
            for size, b, first, end in sharding.best_fit_decreasing(list(sizes.items()), bins, capacity):
                got[b] += size * (end - first)
            room = [capacity] * (bins or 0)
            for s in sorted(sizes.elements(), reverse=True):
                fits = [(r, i) for i, r in enumerate(room) if r >= s]
                if fits:
                    room[min(fits)[1]] -= s
                elif bins:
                    room[max((r, i) for i, r in enumerate(room))[1]] -= s
                else:
                    room.append(capacity - s)
            assert sorted(got.values()) == sorted(capacity - r for r in room)


def test_shard_keeps_groups_and_balance(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for source, shards in ((docs, 16), (hard_docs, 3)):
        rows = sharding.shard(source, shards).collect()
        texts = sorted((r["doc_id"] or -1, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in source.collect())
        assert sorted((r["doc_id"] or -1, r["text_crc32"], r["size"]) for r in rows) == texts
        where, load, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in rows:
            where[r["text_crc32"], r["size"]].add(r["shard"])
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in where.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(no_docs).count() == 0
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(7)).collect()}


# mixing


def test_targets():
    got = mixing.targets({"a": 100, "b": 1000, None: 10, "é": 50})
    assert sum(got.values()) == Fraction(3, 2) * 1160
    assert got["a"] == 200 and all(got[s] <= 2 * n for s, n in {"a": 100, "b": 1000, None: 10, "é": 50}.items())
    assert mixing.targets({"a": 0}) == {"a": 0} and mixing.targets({}) == {}


def test_mix(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame in (docs, hard_docs):
        rows = mixing.mix(frame, carry=True).collect()
        assert len(rows) == frame.count()
        taken, size, target, most = Counter(), Counter(), {}, Counter()
        for r in rows:
            row = dict(zip(frame.columns, r["_row"][1:]))
            s = row["source"]
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
            taken[s] += r["taken"]
            size[s] += r["size"]
            target[s] = r["target"]
            most[s] = max(most[s], r["size"])
        want = mixing.targets(dict(size))
        for s in want:
            assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    first = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    assert first == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    # which documents are taken, from the hashes alone and plain sums
    keyed = docs.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in keyed:
        sizes[r["source"]] += len(r["text"].encode().split())
    plain, goals = {}, mixing.targets(dict(sizes))
    place = lambda r: hashlib.md5(f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:15]
    for source in sizes:
        whole, before = int(goals[source] // sizes[source]), 0
        rest = goals[source] - whole * sizes[source]
        for r in sorted((r for r in keyed if r["source"] == source), key=place):
            n = len(r["text"].encode().split())
            plain[r["doc_id"]] = n * min(2, whole + (rest > 0 and before + Fraction(n, 2) <= rest))
            before += n
    assert dict(first) == plain
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mix(no_docs).count() == 0


#: Every name that an operator uses inside.
RESERVED = ["_", "_row", "_id", "_t", "_h", "_null", "_tie", "_c", "_all", "_p", "_task", "_first", "_doc", "_gone", "_text", "_text_kept", "_size", "_src", "_k", "_b", "_w", "_r", "_a", "_n0", "_s0", "_g", "_m", "_i", "_j", "_epoch", "row", "c", "c0", "c1", "node", "n", "fp", "root", "rank", "before", "copies", "taken", "target", "size", "shard", "slot", "y", "h", "r", "part", "component_id"]


def test_columns_of_any_name_pass_unchanged(spark, hard_docs):
    docs = hard_docs.select("doc_id", "text", "lang", "source", *(F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce(F.col("text"), F.lit(""))).alias(name) for name in RESERVED), F.lit(1).alias("with.dot and blank"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    whole = Counter(map(repr, map(tuple, docs.collect())))
    plain = hard_docs.select("doc_id", "text", "lang", "source")
    for f in (
        lambda d: exact_dedup.content_sort(d).filter("kept").select(*(F.col(f"`{c}`") for c in d.columns)),
        lambda d: simhash.drop_near_duplicates(d),
        lambda d: simhash.drop_near_duplicates(d, similarity=None),
        lambda d: toxicity.drop_toxic(d, labels),
        lambda d: mixing.mixed_rows(d).distinct(),
    ):
        out = f(docs)
        got = Counter(map(repr, map(tuple, out.collect())))
        assert out.columns == docs.columns and set(got) <= set(whole)
        assert sum(got.values()) == f(plain).count()
    for f, pick in ((mixing.mix, ["doc_id", "size", "taken"]), (packing.pack, ["doc_id", "n_tokens", "bucket"]), (sharding.shard, ["doc_id", "size", "shard"]), (simhash.similar_documents, ["doc_id", "component_id"]), (simhash.near_duplicates, ["doc_id", "fp", "component_id"])):
        a, b = (sorted(map(repr, f(d).select(*pick).collect())) for d in (docs, plain))
        assert a == b
    a, b = (sorted(map(repr, toxicity.toxicity(d, labels).select("doc_id", "score", "predicted").collect())) for d in (docs, plain))
    assert a == b


def test_exact_dedup_keeps_one_of_rows_that_repeat_an_identifier(spark):
    """The rows reach the operator through a shuffle whose order differs from run to run."""
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 7).alias("extra")).repartition(6).sortWithinPartitions(F.rand())
    more = spark.range(100).select("id", F.concat(F.lit("t"), F.col("id") % 40), F.col("id"))
    for keep in ("smallest", "largest"):
        got = exact_dedup.content_sort(rows.union(more), keep=keep)
        assert got.filter("text = 'same' and kept").count() == 1 and got.filter("kept").count() == 41


# packing


def test_best_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        histogram = Counter(rng.randint(0, 30) for _ in range(rng.randint(1, 40)))
        k = rng.randint(1, 4)
        waste = lambda bounds, h=histogram: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in h.items())
        lengths = sorted(histogram)
        best = min(waste([*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        got = packing.best_bounds(dict(histogram), k)
        assert len(got) <= k and got == sorted(set(got)) and waste(got) == best
    assert packing.best_bounds({}) == []


def test_pack(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame, budget in ((docs, 4096), (hard_docs, 64)):
        rows = packing.pack(frame, budget=budget).collect()
        assert len(rows) == frame.count()
        batches = defaultdict(list)
        for r in rows:
            assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
            batches[r["bucket"], r["batch"]].append(r)
        last = Counter()
        for b, _ in batches:
            last[b] += 1
        for (b, n), members in batches.items():
            assert sorted(r["place"] for r in members) == list(range(len(members)))
            assert len(members) == 1 or len(members) * members[0]["bucket_len"] <= budget
            assert len(members) == members[0]["batch_rows"] or n == last[b] - 1
    assert packing.pack(no_docs).count() == 0


def test_spread_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 5).alias("w"))
    by = defaultdict(list)
    for r in spread_rank(df, ["k"], [F.col("id")], weight=F.col("w"), bits=3).collect():
        by[r["k"]].append((r["rank"], r["before"], r["w"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()
