"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_rank, table, utf8_bytes

SHARDS = 16


class _Node:
    """A node of an AVL tree."""

    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _turn(node: _Node, side: str, other: str) -> _Node:
    """Rotate so that the child on ``other`` rises."""
    top = getattr(node, other)
    setattr(node, other, getattr(top, side))
    setattr(top, side, node)
    for n in (node, top):
        n.height = 1 + max(_height(n.left), _height(n.right))
    return top


def _balanced(node: _Node) -> _Node:
    node.height = 1 + max(_height(node.left), _height(node.right))
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _turn(node.left, "left", "right")
        return _turn(node, "right", "left")
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _turn(node.right, "right", "left")
        return _turn(node, "left", "right")
    return node


def _insert(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _insert(node.left, key)
    else:
        node.right = _insert(node.right, key)
    return _balanced(node)


def _remove(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key < node.key:
        node.left = _remove(node.left, key)
    elif key > node.key:
        node.right = _remove(node.right, key)
    elif node.left is None or node.right is None:
        return node.left or node.right
    else:
        after = node.right
        while after.left:
            after = after.left
        node.key = after.key
        node.right = _remove(node.right, after.key)
    return _balanced(node)


class _Bins:
    """Bins in an AVL tree by (remaining, bin): the tightest fit, removal and insertion take logarithmic time."""

    def __init__(self, remaining: list[int]) -> None:
        self.root = None
        for i, r in enumerate(remaining):
            self.put(r, i)

    def tightest(self, size: int) -> tuple[int, int] | None:
        found, node = None, self.root
        while node:
            if node.key >= (size, -1):
                found, node = node.key, node.left
            else:
                node = node.right
        return self._take(found) if found else None

    def roomiest(self) -> tuple[int, int]:
        node = self.root
        while node.right:
            node = node.right
        return self._take(node.key)

    def _take(self, key: tuple[int, int]) -> tuple[int, int]:
        self.root = _remove(self.root, key)
        return key

    def put(self, remaining: int, bin_: int) -> None:
        self.root = _insert(self.root, (remaining, bin_))


def best_fit_decreasing(histogram: list[tuple[int, int]], bins: int | None, capacity: int) -> list[tuple[int, int, int, int]]:
    """Pack ``(size, count)`` groups; gives runs ``(size, bin, first, last + 1)`` of the ranks within a size.

    Sizes fall; each group enters the bin with the least room that still holds it. Equal groups that follow each other
    enter the same bin until it is full, so a run is placed at once. With ``bins`` given there are no others: what fits
    nowhere goes where most room is. Without, a new bin of ``capacity`` opens (larger groups get a bin of their own).
    """
    tree = _Bins([capacity] * (bins or 0))
    opened, runs = bins or 0, []
    for size, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            found = tree.tightest(size)
            if found is not None:
                room, b = found
                k = min(count - done, room // size)
            elif bins:
                room, b = tree.roomiest()
                k = 1
            else:
                room, b, opened = max(capacity, size), opened, opened + 1
                k = min(count - done, room // size)
            tree.put(room - k * size, b)
            runs.append((size, b, done, done + k))
            done += k
    return runs


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs``' identifiers with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    A row's size is its UTF-8 bytes plus one (null counts as empty). Rows of equal text form a group that is never
    split. With ``shards`` the capacity is an equal share of all bytes; with ``capacity`` alone, as few bins as best fit
    decreasing finds are opened. Only the histogram of group sizes reaches the driver: at most ``sqrt(2 * bytes)``
    entries, as the sizes differ. Ranks of groups within a size and slots within a shard come from distributed prefix
    counts. A group larger than the capacity stays whole and fills a shard beyond it. Ties, repeated rows, nulls and
    empty tables need no special case; extra columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (utf8_bytes(F.col(text)) + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("_g")))
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_size"))
    histogram = [(r["_size"], r["n"]) for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    total = sum(s * n for s, n in histogram)
    runs = best_fit_decreasing(histogram, shards if capacity is None else None, capacity or -(-total // (shards or 1)))
    by_size: dict[int, list] = {}
    for size, b, _, end in runs:
        by_size.setdefault(size, []).append((end, b))
    plan = spark.createDataFrame([(s, r) for s, r in by_size.items()], "_size long, _runs array<struct<stop: long, bin: int>>")
    ranked = spread_rank(groups, ["_size"], [F.col("_g")])
    placed = ranked.join(plan, "_size").select("_g", F.filter("_runs", lambda r: r["stop"] > F.col("rank"))[0]["bin"].alias("shard"))
    out = spread_rank(rows.join(placed, "_g"), ["shard"], [F.col("doc_id"), F.col("_g")])
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
