"""Token-ID output: shards of token ids, compressed by Re-Pair grammars that allow random access."""

from __future__ import annotations

import os
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

END = 2
MAGIC = b"RPTK"
#: Tokens after which a shard is closed; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
#: Symbols of a shard fit 16 bits, unless its vocabulary is larger or the grammar is to be complete.
NARROW = 1 << 16
#: A round replaces so many pairs at most, none seen more seldom than this; rounds end when symbols run out or when the
#: pairs left are fewer than one in so many places of the sequence. A complete grammar has no such ends.
ROUND_PAIRS, LEAST_COUNT, LEAST_SHARE = 8192, 8, 1000
#: Pieces whose ids a worker keeps (beyond, it starts anew), the table that finds them, and the bytes of a piece with its
#: blank beyond which its text is encoded whole.
KNOWN, TABLE_BITS, LONGEST = 1 << 21, 23, 128
#: Texts with any of these are encoded whole: white space other than a blank or line end, and two of those together.
_WIDE_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + ("  ", "\n\n", " \n", "\n ")
#: Characters of text that are encoded at once; a longer text is encoded alone.
PART = 1 << 20
#: Pieces that the tokenizer gets as one text.
GROUP = 256
_ODD, _TO_SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(46)


# Re-Pair


def _slot(pair: np.ndarray) -> np.ndarray:
    """Place of a pair in a table of 2**18."""
    return (pair.astype(np.uint64) * _ODD) >> _TO_SLOT


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int, complete: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, rules and the places in the sequence where documents end, for token ids and their documents' ends.

    Each round counts all neighbouring pairs, takes the most frequent ones and replaces their occurrences, from the left
    where they overlap, by new symbols. No pair reaches over a document's end, so every document stays a slice. With
    ``complete`` symbols are 32 bits wide and rounds go on until no pair is found twice; else they end by the bounds
    ``NARROW``, ``LEAST_COUNT`` and ``LEAST_SHARE``, which cost a little length and save most of the rounds.
    """
    wide = complete or first_symbol >= NARROW
    kind, shift, symbols = (np.uint64, np.uint64(32), 1 << 32) if wide else (np.uint32, np.uint32(16), NARROW)
    least, share = (2, None) if complete else (LEAST_COUNT, LEAST_SHARE)
    seq, last = ids.astype(kind), np.zeros(len(ids), bool)
    last[ends - 1] = True
    rules = np.zeros((0, 2), np.uint32)
    while True:
        room = min(ROUND_PAIRS, symbols - first_symbol - len(rules))
        if len(seq) < 2 or room <= 0:
            break
        pair = seq[:-1] << shift | seq[1:]
        counted = np.sort(pair[~last[:-1]])
        start = np.flatnonzero(np.concatenate([[True], counted[1:] != counted[:-1]])) if len(counted) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(counted)))
        often = np.flatnonzero(count >= least)
        if not len(often) or (share and count[often].sum() * share < len(seq)):
            break
        often = counted[start[often[np.lexsort((counted[start[often]], -count[often]))]]]
        # a table of hashes finds the pairs; of those in one slot the most frequent takes part in this round
        often = often[: 2 * room]
        often = often[np.sort(np.unique(_slot(often), return_index=True)[1])[:room]]
        chosen = np.sort(often)
        slot = np.full(1 << 18, -1, np.int16)
        slot[_slot(chosen)] = np.arange(len(chosen), dtype=np.int16)
        rank = slot[_slot(pair)]
        at = np.flatnonzero((rank >= 0) & ~last[:-1])
        rank = rank[at]
        hit = chosen[rank] == pair[at]
        at, rank = at[hit], rank[hit]
        # of a run of overlapping places every second one is replaced
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.flatnonzero(fresh)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, rank = at[odd], rank[odd]
        present = np.bincount(rank, minlength=len(chosen)) > (complete and len(chosen) > 1)
        if complete and not present.any():  # overlaps left none of them twice: the most frequent alone, so that rounds end
            present[np.argmax(np.bincount(rank, minlength=len(chosen)))] = True
        used, new = np.flatnonzero(present), np.cumsum(present) - 1
        at, rank = at[present[rank]], rank[present[rank]]
        seq[at] = (first_symbol + len(rules) + new[rank]).astype(kind)
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        rules = np.concatenate([rules, np.stack([chosen[used] >> shift, chosen[used] & ((kind(1) << shift) - kind(1))], axis=1).astype(np.uint32)])
    return seq, rules, np.flatnonzero(last) + 1


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Number of tokens of each symbol."""
    length = np.ones(first_symbol + len(rules), np.int64)
    at = 0
    while at < len(rules):  # rules that only use known symbols, as many at a time as there are
        ready = np.flatnonzero(rules[at:].max(axis=1) >= first_symbol + at)
        stop = at + (int(ready[0]) if len(ready) else len(rules) - at)
        length[first_symbol + at : first_symbol + stop] = length[rules[at:stop, 0]] + length[rules[at:stop, 1]]
        at = stop
    return length


def expand(seq: np.ndarray, rules: np.ndarray, length: np.ndarray, first_symbol: int) -> np.ndarray:
    """Token ids of a slice of the sequence: all symbols are halved at once until none is left."""
    seq = seq.astype(np.int64)
    while True:
        at = np.flatnonzero(seq >= first_symbol)
        if not len(at):
            return seq.astype(np.uint32)
        place = at + np.arange(len(at))
        out = np.empty(len(seq) + len(at), np.int64)
        plain = np.ones(len(out), bool)
        plain[place] = plain[place + 1] = False
        pair = rules[seq[at] - first_symbol]
        out[place], out[place + 1] = pair[:, 0], pair[:, 1]
        out[plain] = np.delete(seq, at)
        seq = out


# file format: header, rules, rule lengths, sequence, and for each document its end in the sequence and among the tokens


_HEAD = "<4sIIIQQI"


def write_shard(ids: np.ndarray, ends: np.ndarray, first_symbol: int, complete: bool = False) -> bytes:
    seq, rules, seq_ends = compress(ids, ends, first_symbol, complete)
    lengths = expansion_lengths(rules, first_symbol)[first_symbol:]
    width = 2 if first_symbol + len(rules) <= NARROW else 4
    head = struct.pack(_HEAD, MAGIC, first_symbol, len(rules), len(ends), len(seq), len(ids), width)
    return b"".join([head, rules.astype(f"<u{width}").tobytes(), lengths.astype("<u4").tobytes(), seq_ends.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Shard:
    """Reader of a shard's bytes; ``document(i)`` decodes nothing but the document."""

    def __init__(self, data: bytes) -> None:
        magic, self.first, n_rules, n_docs, n_seq, self.n_tokens, width = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(_HEAD)
        parts = []
        for kind, n in ((f"<u{width}", 2 * n_rules), ("<u4", n_rules), ("<u8", n_docs), ("<u8", n_docs), (f"<u{width}", n_seq)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.rules, self.lengths, self.seq_ends, self.ends, self.seq = parts[0].reshape(-1, 2), *parts[1:]

    def __len__(self) -> int:
        return len(self.ends)

    def document(self, i: int) -> np.ndarray:
        start = int(self.seq_ends[i - 1]) if i else 0
        return expand(self.seq[start : int(self.seq_ends[i])], self.rules, self.lengths, self.first)

    def all(self) -> np.ndarray:
        """All ids: each symbol's expansion is made once, unless together they are longer than the ids, and gathered."""
        if self.lengths.sum(dtype=np.int64) > self.n_tokens:
            return expand(self.seq, self.rules, self.lengths, self.first)
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), expand(np.arange(self.first, self.first + len(self.rules)), self.rules, self.lengths, self.first)])
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        size, start = sizes[self.seq], (np.cumsum(sizes) - sizes)[self.seq]
        return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(self.n_tokens)]


# tokenizing


class Encoder:
    """Token ids of texts by the tokenizers library, with the ids of pieces between single blanks and line ends kept.

    The vocabulary's pre-tokenizer never joins characters over a single space (which begins the next piece) or a single
    line end (a piece of its own), so pieces can be encoded apart. Texts with any other white space, with a very long
    piece, or with the string of an added token, which the library finds before it splits, are encoded whole.

    Pieces are told apart by two multilinear hashes with random weights, 128 bits together, which numpy makes of all
    pieces of a part at once; known ones are found in a table of slots, and their ids gathered by number.
    """

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values(), default=0) + 1
        self.kind = np.uint16 if self.size <= NARROW else np.uint32
        self.whole = (*_WIDE_SPACE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content))
        begins = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            begins[i] = token.startswith("Ġ")
        self.begins = begins
        self.newline_ids = self._ids("\n")
        self.newline_id = int(self.newline_ids[0])
        self.weights = np.random.default_rng(17).integers(0, 1 << 64, (2, LONGEST + 2), np.uint64) | np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.names, self.used = np.zeros((2, KNOWN), np.uint64), 0
        self.flat, self.starts, self.stops = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, missing: list[str], by: str) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces together; their ids, with the separator's in front of each, and where each begins."""
        groups = [by + by.join(missing[i : i + GROUP]) for i in range(0, len(missing), GROUP)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        first = np.flatnonzero(self.begins[ids] if by == " " else ids == self.newline_id)
        assert len(first) == len(missing)
        return ids, first

    def _add(self, keys: list[str], names: np.ndarray) -> None:
        """Keep the ids of new pieces. A piece that opens a line has the line end in front, and a text's first a \\r."""
        kind = np.array([2 if k[:1] not in ("\n", "\r") else int(len(k) > 1) for k in keys])
        starts, stops, flat, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [self.flat], len(self.flat)
        for which, by in ((0, ""), (1, "\n"), (2, " ")):
            places = np.flatnonzero(kind == which)
            if not len(places):
                continue
            found = [keys[i] for i in places.tolist()]
            skip = np.array([k[0] == "\r" for k in found], np.int64) if which < 2 else 0
            if which:
                own, first = self._learn([k[1:] for k in found] if which == 1 else found, by)
            else:
                own, first = np.tile(self.newline_ids, len(found)), np.arange(len(found)) * len(self.newline_ids)
                skip = skip * len(self.newline_ids)
            starts[places], stops[places] = at + first + skip, at + np.append(first[1:], len(own))
            flat.append(own)
            at += len(own)
        self.flat = np.concatenate(flat)
        self.starts, self.stops = np.concatenate([self.starts, starts]), np.concatenate([self.stops, stops])
        fresh = np.arange(self.used, self.used + len(keys))
        self.names[:, fresh] = names
        self.used += len(keys)
        slot = (names[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(fresh):  # of pieces that want one free slot the first gets it, the others go on
            free = self.table[slot] < 0
            slots, first = np.unique(slot[free], return_index=True)
            self.table[slots] = fresh[free][first]
            left = self.table[slot] != fresh
            fresh, slot = fresh[left], (slot[left] + 1) & ((1 << TABLE_BITS) - 1)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it isn't known."""
        out = np.full(names.shape[1], -1, np.int64)
        at, slot = np.arange(names.shape[1]), (names[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(at):
            found = self.table[slot]
            hit = (found >= 0) & (self.names[0, found] == names[0, at]) & (self.names[1, found] == names[1, at])
            out[at[hit]] = found[hit]
            on = (found >= 0) & ~hit
            at, slot = at[on], (slot[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _gather(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without wide space."""
        if not texts:
            return []
        raw = np.frombuffer(" ".join(["\r" + t.replace("\n", " \n") for t in texts]).encode(), np.uint8)
        raw = np.concatenate([np.array([32], np.uint8), raw])
        begin = np.flatnonzero(raw == 32)
        size = np.diff(np.append(begin, len(raw)))
        first = np.flatnonzero(raw[np.minimum(begin + 1, len(raw) - 1)] == 13)  # the piece that opens each text
        if size.max() > LONGEST:
            long = np.add.reduceat((size > LONGEST).astype(np.int64), first) > 0
            rest = iter(self._gather([t for t, x in zip(texts, long) if not x]))
            return [self._ids(t).tobytes() if x else next(rest) for t, x in zip(texts, long)]
        place = np.arange(len(raw)) - np.repeat(begin, size)
        wide = raw.astype(np.uint64)
        names = np.stack([np.add.reduceat(wide * w[place], begin) + size.astype(np.uint64) * w[-1] for w in self.weights])
        number = self._find(names)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            _, one = np.unique(names[0, fresh], return_index=True)
            new = fresh[one]
            if self.used + len(new) > KNOWN:
                self._forget()
                _, new = np.unique(names[0], return_index=True)
                if len(new) > KNOWN:
                    return [self._ids(t).tobytes() for t in texts]
                fresh = np.arange(len(size))
            data, lo, hi = raw.tobytes(), (begin[new] + 1).tolist(), (begin[new] + size[new]).tolist()
            self._add([data[a:b].decode() for a, b in zip(lo, hi)], names[:, new])
            number[fresh] = self._find(names[:, fresh])
        if (number < 0).any():  # two pieces of this part share the first hash: encode them without it
            return [self._ids(t).tobytes() for t in texts]
        start, length = self.starts[number], self.stops[number] - self.starts[number]
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(start - before[:-1], length) + np.arange(before[-1])].tobytes()
        ends = (self.flat.itemsize * before[np.append(first, len(size))]).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as 16-bit integers, or 32-bit ones for a larger vocabulary."""
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= PART:
                size += len(texts[stop])
                stop += 1
            wide = [any(c in t for c in self.whole) for t in texts[at:stop]]
            plain = iter(self._gather([t for t, w in zip(texts[at:stop], wide) if not w]))
            for t, w in zip(texts[at:stop], wide):
                yield self._ids(t).tobytes() if w else next(plain)
            at = stop

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.encode_all([text]))


def encoder(data: bytes) -> Encoder:
    """This process's encoder, kept from task to task."""
    state = sys.modules.setdefault("_rastrella_state", types.ModuleType("_rastrella_state"))
    name, found = (len(data), zlib.crc32(data)), state.__dict__.get("encoder")
    if found is None or found[0] != name:
        found = state.encoder = (name, Encoder(data))
    return found[1]


# Spark


def write_tokens(docs: DataFrame, path: str, folder: str, text: str = "text", doc_id: str = "doc_id", end: int = END, shard_tokens: int = SHARD_TOKENS, complete: bool = False) -> None:
    """Encode all documents in ascending order of identifier (null first) and write shards to ``folder``.

    Documents are range-partitioned and sorted by identifier (rows that share one by their text); each partition's
    documents fill shards of about ``shard_tokens`` ids, each with a Re-Pair grammar of its own. Spark's writer puts one
    row a shard into Parquet files: part, shard, the identifiers, the number of tokens, and the shard's bytes. The driver
    reads the tokenizer's file at ``path`` and sends its bytes to the workers. With ``complete`` the grammars are too.

    Null texts count as empty, repeated rows stay apart, an empty table gives no documents, extra columns are ignored.
    Identifiers that are not whole numbers are kept as strings, and sorted as such.
    """
    spark = docs.sparkSession
    with open(path, "rb") as file:
        shipped = spark.sparkContext.broadcast(file.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[doc_id].dataType
    kind = "long" if id_type.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    out = pa.int64() if kind == "long" else pa.string()
    rows = docs.select(F.col(f"`{doc_id}`").cast(kind).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shipped.value)
        first_symbol = max(coder.size, end + 1)
        tail = np.array([end], coder.kind).tobytes()
        width = len(tail)
        ids, parts, size, part, shard = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // width for p in parts])
            data = write_shard(np.frombuffer(b"".join(parts), coder.kind), ends, first_symbol, complete)
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(out)), pa.array([int(ends[-1])], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "ids", "n", "data"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for name, raw in zip(names, coder.encode_all(texts)):
                parts.append(raw + tail)
                ids.append(name)
                size += len(parts[-1]) // width
                if size >= shard_tokens:
                    yield close()
                    ids, parts, size, shard = [], [], 0, shard + 1
        if parts:
            yield close()

    rows.mapInArrow(run, f"part int, shard int, ids array<{kind}>, n long, data binary").write.mode("overwrite").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, tokens: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files, and its ``tokens`` if asked for.

    A document's start is the number of ids before it in the whole folder: shards are summed inside their part by a
    window, and parts, as few as were written, by another.
    """
    shards = spark.read.parquet(folder)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    sizes = shards.groupBy("part").agg(F.sum("n").alias("n")).collect()
    at, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["n"]
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = shards.select("part", "shard", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_in")).join(F.broadcast(spark.createDataFrame(offsets, "part int, _at long")), "part").select("part", "shard", (F.col("_in") + F.col("_at")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, names, data in zip(*(batch.column(i) for i in range(3))):
                shard = Shard(data.as_py())
                ids, ends = np.ascontiguousarray(shard.all(), "<u4"), shard.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                cols = [pa.array(names.as_py(), names.type.value_type), pa.array(starts + begin.as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if tokens:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["tokens"][: len(cols) - 4]])

    # begins is broadcast only while it is small; else both sides are dealt by part and shard
    rows = shards.join(begins, ["part", "shard"]).select("begin", "ids", "data")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", tokens array<long>" * tokens)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which executors and driver share."""
    cut(spark.range(1))  # sets the folder where none is
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Encode every document, write the files, read them back; null texts count as empty, repeated rows stay apart."""
    import public_tokenizers

    folder = shared_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)
