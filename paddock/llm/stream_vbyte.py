"""Token-id files: frequency-ranked ids in byte-aligned variable length, control bytes apart.

Ids are replaced by their rank in the whole corpus (the commonest id is 0, ties by id) and
written with one to four bytes each.  Two bits per id, four ids to a control byte, give the
lengths; control bytes stand together before the data bytes, so a reader finds all lengths by
one table lookup and all values by a few gathers.

A token file is a folder with two Parquet tables, so that any file system Spark reaches will do
and a lost task is simply written again:

* ``ranks``: (rank, id);
* ``blocks``: (part, first, payload).  Blocks hold whole documents in ascending doc_id order;
  part numbers ascend with doc_id, ``first`` counts the ids before the block in its part.

Payload, little-endian: ``FRV1``, documents (uint32), ids (uint32), doc ids (int64 each), ids of
each document (uint32 each), control bytes, data bytes.  A null doc_id is stored as the smallest
int64; it comes first.

Every document ends with ``END`` (id 0).  Texts are tokenised once, into a table in the shared
folder; ranks are counted from it, then it is range-partitioned by doc_id.  The words of a text
repeat, so ids are remembered by word in bounded tables: texts are cut where the tokenizer cuts
anyway, and only distinct words of a batch are looked up.

Defined results: a null or empty text has the end id only.  Repeated doc_ids are all written,
in the order of their ids.  An empty table gives an empty file.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb
from paddock.scratch import Scratch

END = 0
BLOCK_IDS = 1 << 16
PART_IDS = 1 << 23
REMEMBERED = 500_000
TOKEN_BYTES = 1 << 23
TOKEN_ROWS = 8192
NO_ID = -(1 << 63)

#: The byte-level rules by which ``Words`` may cut for itself, and the model's settings beside vocabulary and merges.
_PRE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
#: Kinds of bytes; the letters beyond ASCII are U+00C0 to U+024F without the two signs among them.
_OTHER, _WHITE, _LETTER, _DIGIT, _MARK = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _WHITE
#: The letters that stand for the bytes of each character in the model.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_OWN)))}
_LETTERS = {chr(c): "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0x250)}

#: Lengths of the four ids of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.asarray(values, np.uint32)
    size = 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = v[has] >> np.uint32(8 * k) & np.uint32(255)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    head = b"FRV1" + np.array([len(doc_ids), len(ranks)], "<u4").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), *encode(ranks)])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if payload[:4] != b"FRV1":
        raise ValueError("not a block of token ids")
    docs, n = (int(x) for x in np.frombuffer(payload, "<u4", 2, 4))
    doc_ids = np.frombuffer(payload, "<i8", docs, 12)
    sizes = np.frombuffer(payload, "<u4", docs, 12 + 8 * docs)
    rest = np.frombuffer(payload, np.uint8, offset=12 + 12 * docs)
    return doc_ids, sizes, decode(rest[: -(-n // 4)], rest[-(-n // 4) :], n)


def _plain(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts hold only ASCII marks, digits, Latin letters, spaces, tabs and line ends."""
    bad = _KIND[data] == _OTHER
    nine, next_ = data[:-1] == 0xC9, data[1:]
    bad[:-1] |= (nine & (next_ >= 0x90)) | ((data[:-1] == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7)))
    return tb.per_text(bad, offs) == 0


def _parts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the parts that the rules of ``_PRE`` cut plain texts into."""
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty_like(kind)
    before[0], before[1:] = _WHITE, kind[:-1]
    start = kind != before
    start[1:] &= data[:-1] != 0x20  # a space belongs to what follows
    start |= first[:-1]
    # The last of some white space stands alone or with what follows.
    alone = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~first[1:-1])
    start[alone] = True
    at = np.flatnonzero((data == 0x27) & start)
    end = offs[np.searchsorted(offs, at, "right")]
    ends = np.append(data, np.zeros(2, np.uint8))
    one, two = ends[at + 1], ends[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < end)
    pair = ((one == 0x6C) & (two == 0x6C)) | (((one == 0x72) | (one == 0x76)) & (two == 0x65))
    long = pair & (at + 2 < end) & ~short
    start[at[short | long] + 1] = False
    for flags, size in ((short, 2), (long, 3)):
        to = at[flags] + size
        start[to[to < len(data)]] = True
    return np.flatnonzero(start)


class Words:
    """Tokenizer that remembers the ids of words.

    With the byte-level rules of ``_PRE`` numpy cuts plain texts into the parts that the model
    takes one by one, and the model gives the ids of parts not met lately.  Other texts are cut
    before spaces that precede no white space, where those rules cut too, and new words go through
    the tokenizer as they are; so does each text of a tokenizer with other rules.
    """

    _held: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in rules["added_tokens"]]
        own = {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}
        spaced = any(c.isspace() for t in self.added for c in t)
        self.cuts = rules["normalizer"] is None and rules["pre_tokenizer"] == _PRE and own == _MODEL and not spaced
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(texts)
        cut = [re.split(r"(?= \S)", t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:  # keep what is in use
            self.known = known = {w: known[w] for words in cut for w in words if w in known}
        new = [w for w in set().union(*cut) if w not in known]
        known.update(zip(new, self._encode(new)))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def _by_part(self, parts: list[str]) -> list[bytes]:
        known, ids_of = self.parts, self.tokenizer.model.tokenize
        if len(known) > REMEMBERED:
            self.parts = known = {p: known[p] for p in parts if p in known}
        for p in parts:
            if p not in known:
                known[p] = array("I", [t.id for t in ids_of("".join([_LETTERS[c] for c in p]))]).tobytes()
        return [known[p] for p in parts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with ``END`` after each, and how many each has; null counts as empty."""
        data, offs = tb.flat(texts)
        plain = _plain(data, offs) if self.cuts and len(data) else np.zeros(len(texts), bool)
        for t in self.added if plain.any() else ():
            plain &= ~pc.match_substring(pc.fill_null(texts.cast(pa.large_string()), ""), t).to_numpy(zero_copy_only=False)
        start = _parts(data, offs) if plain.any() else np.zeros(0, np.int64)
        of = np.searchsorted(offs, start, "right") - 1
        whole = np.flatnonzero(~plain & (np.diff(offs) > 0))  # these are one part each
        start = np.sort(np.concatenate([start[plain[of]], offs[whole]]))
        of = np.searchsorted(offs, start, "right") - 1
        bounds = np.append(start, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        seq, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        odd = np.zeros(len(names), bool)
        odd[seq[~plain[of]]] = True
        ids = (iter(self._by_part([w for w, o in zip(names, odd) if not o])), iter(self._by_word([w for w, o in zip(names, odd) if o])))
        table = [next(ids[o]) for o in odd.tolist()]
        last = np.searchsorted(of, np.arange(len(texts)), "right")
        seq = np.insert(seq, last, len(table))
        table.append(np.array([END], "<u4").tobytes())
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, begin, size = np.frombuffer(b"".join(table), "<u4"), (np.cumsum(size) - size)[seq], size[seq]
        to = np.cumsum(size)
        ids = flat[np.repeat(begin - to + size, size) + np.arange(size.sum())]
        return ids, np.diff(to[last + np.arange(len(texts))], prepend=0)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        words = Words.of(path)
        for part, _, _ in tb.pieces(batches, "text", TOKEN_BYTES, TOKEN_ROWS):
            ids, n = words(tb.column(part, "text"))
            raw, ends = memoryview(ids).cast("B"), np.cumsum(n * 4)
            packed = [squeeze.compress(raw[b - s : b]) for b, s in zip(ends.tolist(), (n * 4).tolist())]
            yield pa.RecordBatch.from_arrays([tb.column(part, "doc_id"), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    return run


def _ids(column: pa.Array) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor()
    return [np.frombuffer(plain.decompress(x.as_buffer()), "<u4") for x in column]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            n = np.bincount(np.concatenate(_ids(batch.column(0)[k : k + 256])))
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _blocks(rank_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, docs, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            ids = rank_of.value[np.concatenate(held)]
            payload = pack(np.array(docs, np.int64), np.array([len(x) for x in held]), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "first", "n", "payload"],
            )

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1))):
                docs.append(NO_ID if doc is None else doc)
                held.append(ids)
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield block()
                    first, docs, held, n = first + n, [], [], 0
        if docs:
            yield block()

    return run


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the token file of all documents to a new folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark, "tokens") as tmp:
        tokens = tmp.write(rows.mapInArrow(_tokenise(tokenizer), "doc_id bigint, n bigint, ids binary"))
        counts = tokens.select("ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
        held = sorted((-r["n"], r["id"]) for r in counts.collect())  # as many rows as the vocabulary has ids
        ids = np.array([r[1] for r in held], np.int64)
        ranks = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        ranks[ids] = np.arange(len(ids))
        spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -sum(r[0] for r in held) // PART_IDS + 1)
        dealt = tokens.repartitionByRange(parts, "doc_id", "n").sortWithinPartitions("doc_id", "n", "ids").select("doc_id", "ids")
        sent = spark.sparkContext.broadcast(ranks)
        dealt.mapInArrow(_blocks(sent), "part int, first bigint, n bigint, payload binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of a token file."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    sent = spark.sparkContext.broadcast(ranks)
    blocks = spark.read.schema("part int, first bigint, n bigint, payload binary").parquet(f"{path}/blocks")
    before, total = [], 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n")).collect())):  # as many rows as parts
        before.append((part, total))
        total += n
    places = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, sizes, values = unpack(payload.as_py())
                ids = sent.value[values]
                ends = np.cumsum(sizes.astype(np.int64))
                each = [ids[e - s : e].astype("<u4") for e, s in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.astype(np.int64), mask=doc_ids == NO_ID),
                        pa.array(at + ends - sizes),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                        pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    rows = blocks.join(places, "part").select((F.col("before") + F.col("first")).alias("at"), "payload")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
