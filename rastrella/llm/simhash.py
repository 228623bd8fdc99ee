"""SimHash near-deduplication: fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, table, unpacked
from .graph import components

SEED = 42
MOST_BITS = 3
SEGMENTS = 8
#: Buckets above this many different fingerprints are linked through shared neighbours instead of comparisons.
HOT_BUCKET = 4096
_CHUNK = 1 << 16
#: Smallest shingle hashes of a set that are looked at, and how many of them it meets others on.
SAMPLE, KEYS = 32, 8
#: A shingle in the samples of more sets than this is a key only for sets that have few others.
HOT_KEY = 1024
#: Sets of a bucket that are compared at once; larger buckets are compared block by block.
BLOCK = 512
#: The bits of sets with fewer shingles scatter more: so many are added to their budget.
SMALL_SET, SMALL_MORE = 16, 24


def fingerprint(text: bytes | None, words: int) -> int:
    """64-bit SimHash of the shingles of ``words`` words (A-Z lower-cased, repeats counted)."""
    found = (text or b"").lower().split()  # bytes: only ASCII letters and the six ASCII white spaces count
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    last = max(0, len(found) - words)
    starts, stops = [0, *ends[:last]], ends[len(ends) - 1 - last :]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def ring_keys(fp: str = "fp") -> list:
    """The keys of a fingerprint, of which two within three bits share one.

    Eight segments of eight bits form a ring. If the differences sum to 3 at most, the pigeonring principle (strong form)
    gives a segment from which every chain of l segments has at most floor(3 l / 8) differences: 0 in the first two, at
    most 1 in the first five. So the first 16 bits of that 40-bit window agree, and one half of its other 24 does too:
    28 bits to match on, with two halves at each of eight turns of the ring.
    """
    x, keys = F.col(fp), []
    for turn in range(SEGMENTS):
        by = 8 * turn
        ring = x if not by else F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, 64 - by))
        for half in (0, 1):
            tail = F.shiftrightunsigned(ring, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            key = F.lit((2 * turn + half) << 28).bitwiseOR(F.shiftleft(ring.bitwiseAND(F.lit(0xFFFF)), 12)).bitwiseOR(tail)
            keys.append(key.cast("long"))
    return keys


def _chain_masks() -> list[list[tuple[np.uint64, int]]]:
    """For each turn, masks of the chains whose budget is looser than the key's equality, with the budgets."""
    full = (1 << 64) - 1
    out = []
    for turn in range(SEGMENTS):
        turned = lambda m, by=8 * turn: ((m << by) | (m >> (64 - by))) & full if by else m
        out.append([(np.uint64(turned((1 << (8 * n)) - 1)), MOST_BITS * n // SEGMENTS) for n in (5, 6, 7, 8)])
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of the links inside the runs of equal keys; batches are sorted by (key, fp)."""
    masks, held_k, held_f = _chain_masks(), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right, gathered = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        turn = key >> 29
        step, alive = 1, np.arange(len(key))
        while True:
            alive = alive[alive < len(key) - step]
            alive = alive[key[alive] == key[alive + step]]
            if not len(alive):
                break
            diff = fp[alive] ^ fp[alive + step]
            near = np.zeros(len(alive), bool)
            for t in np.unique(turn[alive]):
                at = np.flatnonzero(turn[alive] == t)
                for mask, most in masks[t]:  # growing chains; a candidate leaves at the first over its budget
                    at = at[np.bitwise_count(diff[at] & mask) <= most]
                near[at] = True
            left.append(alive[near])
            right.append(alive[near] + step)
            gathered += len(left[-1])
            if gathered > 1_000_000:
                root = _roots(len(key), np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(root != np.arange(len(key)))
                left, right, gathered = [own], [root[own]], 0
            step += 1
        root = _roots(len(key), np.concatenate(left), np.concatenate(right))
        own = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["u", "v"])

    for batch in batches:
        key = np.concatenate([held_k, batch.column(0).to_numpy()])
        fp = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last run may go on
        held_k, held_f = key[end:], fp[end:]
        if end:
            yield links(key[:end], fp[:end])
    if len(held_k):
        yield links(held_k, held_f)


def hot_links(hot: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all of the fingerprints ``hot (fp)`` within three bits, without any pair of them compared.

    Two of them are within three bits exactly if some value lies within one bit of the one and two bits of the other.
    Each value within one bit of any takes the smallest such fingerprint as its centre, and everything within two bits of
    the value is linked to the centre, which is then within three bits. Rows follow the number of fingerprints: 65 and
    2,081 of each.
    """
    near = [0, *(1 << i for i in range(64))]
    far = sorted({a ^ b for a in near for b in near})
    signed = lambda masks: F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    centres = hot.select("fp", F.explode(signed(near)).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("at"), "fp").groupBy("at").agg(F.min("fp").alias("v"))
    around = hot.select("fp", F.explode(signed(far)).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("at"), F.col("fp").alias("u"))
    return around.join(centres, "at").filter("u <> v").select("u", "v").distinct()


def component_names(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, component_id)`` of ``nodes (node, least)``: the smallest ``least`` of the node's component.

    Only nodes with links, which have a row in ``roots (node, root)``, are grouped; the components' names are broadcast if
    a count shows that they are few.
    """
    roots = cut(roots)
    found = cut(nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id")))
    named = nodes.join(roots, "node", "left").join(F.broadcast(found) if found.count() <= 1_000_000 else found, "root", "left")
    # cut, so that a join of all rows with it is dealt anew on both sides, and Spark can split a node with many copies
    return cut(named.select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row.

    Fingerprints at most three bits apart link; a component's name is its smallest ``doc_id``. Equal fingerprints are
    one node, so copies make no pairs. Different ones meet in the buckets of ``ring_keys``; within a bucket candidates
    pass the ring's chain budgets before the whole distance counts, and only a spanning forest of the links is emitted.
    A bucket of more than ``hot_bucket`` goes through ``hot_links``, which is exact too.

    Null and empty texts and those of white space have no words: fingerprint zero, linked like any other. A text with
    fewer words than a shingle is one shingle. Repeated rows and identifiers each get a row; a component of which all
    identifiers are null has a null name. An empty table gives no rows; extra columns are ignored.
    """
    prints = cut(fingerprints(docs, words, text, doc_id))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keyed = nodes.select("fp", F.explode(F.array(*ring_keys())).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, "key")
    cold = met.filter(F.col("n") <= hot_bucket).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    edges = cold.mapInArrow(_link_sorted, "u long, v long")
    edges = edges.unionByName(hot_links(met.filter(F.col("n") > hot_bucket).select("fp").distinct()))
    named = component_names(nodes.select(F.col("fp").alias("node"), "least"), components(edges))
    return prints.join(named.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


# near copies by similarity: wide fingerprints, a sample of the shingles to meet on, and an exact check


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the different shingles of ``words`` words (A-Z lower-cased), ascending."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    last = max(0, len(found) - words)
    starts, stops = [0, *ends[:last]], ends[len(ends) - 1 - last :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, stops)], np.uint64))


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """SimHash of ``64 * SEGMENTS`` bits of a set of shingle hashes, one segment a word."""
    ones, turns = np.zeros(64 * SEGMENTS, np.int64), np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(grams), 255):
        z = grams[at : at + 255, None] + turns
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)


def bit_budget(similarity: float) -> int:
    """Bits in which two sets of this Jaccard similarity differ at most, but for one pair in some thousands.

    Equally large sets share ``2 s / (1 + s)`` of their shingles, and a bit differs with the angle of that cosine; 3.5
    standard deviations are added.
    """
    bits, p = 64 * SEGMENTS, float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(bits * p + 3.5 * np.sqrt(bits * p * (1 - p))))


def sketch(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, node, n, fp, least)`` of every row: a hash of its set of shingles, their number, the wide fingerprint,
    and its ``SAMPLE`` smallest shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, least = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                grams = shingles(t, words)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                sizes.append(len(grams))
                prints.append(wide_fingerprint(grams))
                least.append(grams[:SAMPLE].view(np.int64))
            ends = np.cumsum([0, *map(len, least)]).astype(np.int32)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, SEGMENTS * len(prints) + 1, SEGMENTS, dtype=np.int32)), pa.array(np.concatenate(prints or [np.zeros(0, np.uint64)]).view(np.int64)))
            some = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), fp, some], names=["doc_id", "node", "n", "fp", "least"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, n long, fp array<long>, least array<long>")


def meeting_keys(nodes: DataFrame, similarity: float, hot_bucket: int = HOT_KEY) -> DataFrame:
    """``(gram, node, n, keys)``: the shingles on which each of ``nodes (node, n, least)`` is to meet others; ``keys`` has all of a node.

    Two similar sets share each of their smallest hashes with at least the chance ``similarity``, so of ``KEYS`` ones
    that other sets have too they miss all with ``(1 - similarity) ** KEYS`` at most, less than one pair in ten thousand.
    A shingle in more than ``hot_bucket`` samples (of a passage that many texts share) is a key only for sets that have
    few others: those that could be similar by such passages alone.
    """
    keyed = nodes.select("node", "n", F.size("least").alias("k"), F.explode("least").alias("gram"))
    held = keyed.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1")
    met = keyed.join(held, "gram").withColumn("hot", F.col("m") > hot_bucket)
    mine = Window.partitionBy("node")
    ranked = met.withColumns({"cold": F.col("k") - F.sum(F.col("hot").cast("int")).over(mine), "r": F.row_number().over(mine.orderBy("hot", "gram")), "all": F.row_number().over(mine.orderBy("gram"))})
    needed = F.least(F.lit(KEYS + 4), F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1)
    kept = ranked.filter((~F.col("hot") & (F.col("r") <= KEYS)) | ((F.col("cold") < needed) & (F.col("all") <= KEYS)))
    return kept.select("gram", "node", "n", F.sort_array(F.collect_list("gram").over(mine)).alias("keys"))


def _in_blocks(met: DataFrame) -> DataFrame:
    """Rows of ``met (gram, node, ...)`` by ``run``: the pairs of blocks into which a large bucket is cut.

    Every two rows of a bucket meet in one run; ``side`` tells the blocks of a run apart, -1 where it is one block.
    """
    large = cut(met.groupBy("gram").agg(F.count("*").alias("_m")).filter(F.col("_m") > BLOCK))  # one for BLOCK rows at most
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("_b")).cast("int")
    spread = met.join(F.broadcast(large) if large.count() <= 100_000 else large, "gram", "left").withColumn("_b", F.ceil(F.coalesce("_m", F.lit(1)) / F.lit(BLOCK)).cast("int")).withColumn("_i", own)
    spread = spread.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    run = F.xxhash64("gram", F.least("_i", "_j"), F.greatest("_i", "_j"))
    side = F.when(F.col("_i") == F.col("_j"), -1).otherwise((F.col("_i") > F.col("_j")).cast("int"))
    return spread.withColumn("run", run).withColumn("side", side).drop("_b", "_i", "_j", "_m")


def _by_run(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on batches of whole runs; a run has two blocks at most, but may go over many batches of the input."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
            yield work(whole)

    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column(0).to_numpy()
        end = int(np.searchsorted(run, run[-1]))
        if end or (held and held[-1].column(0)[0] != batch.column(0)[0]):
            held.append(batch.slice(0, end))
            yield from joined()
            held = []
        held.append(batch.slice(end))
    yield from joined()


def ring_pass(differences: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of ``differences`` (bits by segment) have a chain within its budgets from some segment on.

    If all segments together differ in ``most`` bits or fewer, then from one of them every chain of ``l`` consecutive
    segments of the ring differs in ``most * l / SEGMENTS`` at most (pigeonring principle, strong form). So a pair leaves
    a start at the first chain over its budget, and what passes no start needs no whole distance.
    """
    found = np.zeros(len(differences), bool)
    for start in range(SEGMENTS):
        at = np.flatnonzero(~found)
        total = np.zeros(len(at), np.int64)
        for length in range(1, SEGMENTS):
            total = total + differences[at, (start + length - 1) % SEGMENTS]
            inside = total * SEGMENTS <= most[at] * length
            at, total = at[inside], total[inside]
        found[at] = True
    return found


def _close_pairs(run: np.ndarray, side: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the runs of rows sorted by run that size, ring and Hamming distance leave.

    Pairs that ``root`` has connected meanwhile are left out.
    """
    budget, step, alive = bit_budget(similarity), 1, np.arange(len(run))
    while True:
        alive = alive[alive < len(run) - step]
        alive = alive[run[alive] == run[alive + step]]
        if not len(alive):
            return
        other = alive + step
        low, high = np.minimum(n[alive], n[other]), np.maximum(n[alive], n[other])
        ok = ((side[alive] < 0) | (side[alive] != side[other])) & (low >= similarity * high - 1e-9)
        if root is not None:
            ok &= root[alive] != root[other]
        a, b, low = alive[ok], other[ok], low[ok]
        if len(a):
            differences = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
            most = np.where(low < SMALL_SET, budget + SMALL_MORE, budget)
            at = np.flatnonzero(ring_pass(differences, most))
            at = at[differences[at].sum(axis=1) <= most[at]]
            if len(at):
                yield a[at], b[at]
        step += 1


def _segments(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, SEGMENTS)


def candidates(met: DataFrame, similarity: float) -> DataFrame:
    """Of ``met (gram, node, n, fp, keys)``, the different ``(gram, node)`` of sets that come close to another in the bucket.

    A pair counts in the bucket of the first key that both have, and in no other.
    """

    def touched(batch: pa.RecordBatch) -> pa.RecordBatch:
        run, side, gram, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        lists, found = batch.column(6), [np.zeros(0, np.int64)]
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        width = int(np.diff(starts).max(initial=0))
        place = starts[:-1, None] + np.minimum(np.arange(width), np.diff(starts)[:, None] - 1)  # shorter lists repeat their last key
        keys = flat[place]
        for a, b in _close_pairs(run, side, n, _segments(batch.column(5)), similarity):
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                shared = (keys[x][:, :, None] == keys[y][:, None, :]).any(axis=2)
                first = keys[x][np.arange(len(x)), np.argmax(shared, axis=1)]
                here = first == gram[x]
                found += [x[here], y[here]]
        at = np.unique(np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(node[at])], names=["gram", "node"])

    rows = _in_blocks(met).select("run", "side", "gram", "node", "n", "fp", "keys").repartition("run").sortWithinPartitions("run", "node")
    return rows.mapInArrow(lambda batches: _by_run(batches, touched), "gram long, node long").distinct()


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """``(node, n, fp, grams)`` of the nodes ``wanted (node, doc_id)``, each made anew from the text of its smallest row.

    For the comparison of two sets the halves of their hashes are enough: that two of a thousand shingles share one, and
    so change an overlap by one, has a chance of about one in ten thousand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, words) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in made], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            halves = (np.concatenate(made or [np.zeros(0, np.uint64)]) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            prints = np.concatenate([np.zeros(0, np.uint64), *map(wide_fingerprint, made)]).view(np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, len(prints) + 1, SEGMENTS, dtype=np.int32)), pa.array(prints))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.diff(ends).astype(np.int64)), fp, pa.ListArray.from_arrays(pa.array(ends), pa.array(halves))], names=["node", "n", "fp", "grams"])

    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    texts = texts.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_text")
    sets = texts.mapInArrow(run, "node long, n long, fp array<long>, grams array<int>")
    return sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "grams")))


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, text: str, doc_id: str, hot_bucket: int = HOT_KEY) -> DataFrame:
    """Links ``(u, v)`` that connect the similar sets of ``nodes (node, n, fp, least, doc_id)``.

    Sets meet on a few of their shingles. Within a bucket, size, ring chains and the whole Hamming distance of the wide
    fingerprints leave the candidates; the whole sets of these are made once more and compared. A bucket is compared
    block by block, and a run of two blocks gives a spanning forest, not pairs, so that what is made follows the sets.
    """

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        run, side, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        lists = batch.column(5)
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets: dict[int, frozenset] = {}
        root, u, v = np.arange(len(run)), [], []

        def of(i: int) -> frozenset:
            if i not in sets:
                if len(sets) > 4 * BLOCK:  # runs follow each other: those before are not needed again at once
                    sets.clear()
                sets[i] = frozenset(flat[starts[i] : starts[i + 1]].tolist())
            return sets[i]

        # run by run, as what is connected need not be compared
        bounds = np.append(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), len(run))
        fp = _segments(batch.column(4))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            sets.clear()
            own = root[lo:hi]
            for xs, ys in _close_pairs(run[lo:hi], side[lo:hi], n[lo:hi], fp[lo:hi], similarity, own):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    if own[x] != own[y] and len(of(lo + x) & of(lo + y)) * (1 + similarity) >= similarity * (n[lo + x] + n[lo + y]) - 1e-9:
                        own[own == own[y]] = own[x]
                        u.append(lo + x)
                        v.append(lo + y)
        return pa.RecordBatch.from_arrays([pa.array(node[np.array(u, np.int64)]), pa.array(node[np.array(v, np.int64)])], names=["u", "v"])

    met = meeting_keys(nodes, similarity, hot_bucket).join(nodes.select("node", "fp"), "node")
    close = cut(candidates(met, similarity))
    wanted = nodes.select("node", "doc_id").join(close.select("node").distinct(), "node")
    rows = _in_blocks(close).join(_whole_sets(docs, wanted, words, text, doc_id), "node")
    rows = rows.select("run", "side", "node", "n", "fp", "grams").repartition("run").sortWithinPartitions("run", "node")
    return rows.mapInArrow(lambda batches: _by_run(batches, linked), "u long, v long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", hot_bucket: int = HOT_KEY) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row, its component's smallest ``doc_id``.

    Texts link whose sets of shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more: candidates
    within the bit budget of that similarity on ``64 * SEGMENTS`` bits, by ring chains and the whole distance, and then a
    comparison of the whole sets. So no link is wrong, and a similar pair is missed with the small chances that
    ``bit_budget`` and ``meeting_keys`` state. Equal sets are one node, so copies make no pairs.

    Null and empty texts and those of white space have no shingles and equal sets. A text with fewer words than a shingle
    is one shingle. A component of which all identifiers are null has a null name. Repeated rows each get a row; an empty
    table gives none; extra columns are ignored.
    """
    made = cut(sketch(docs, words, text, doc_id))
    nodes = made.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("least").alias("least"), F.min("doc_id").alias("doc_id"))
    nodes = cut(nodes)
    roots = components(similar_links(docs, nodes, words, similarity, text, doc_id, hot_bucket))
    named = component_names(nodes.select("node", F.col("doc_id").alias("least")), roots)
    return made.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float | None = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, the one with its smallest identifier, with all columns of ``docs``.

    Components are those of ``similar_documents``, or of ``near_duplicates`` if ``similarity`` is None. Rows with a null
    identifier stay: they cannot be told apart. Rows that repeat the identifier that stays all stay.
    """
    links = near_duplicates(docs, words, text, doc_id) if similarity is None else similar_documents(docs, words, similarity, text, doc_id)
    gone = links.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(packed(docs.columns).alias("_row"), F.col(f"`{doc_id}`").alias("_doc"))
    return rows.join(gone, F.col("_doc") == F.col("_id"), "left_anti").select(*unpacked("_row", docs.columns))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, on 3-word shingles."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
