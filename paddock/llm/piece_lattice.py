"""Sampled segmentations into sentence pieces without replacement, and their decoding.

The lattice of a text has a node before every character and an edge for every piece of the
vocabulary that fits; a segmentation is a path.  Piece weights fall with the rank of the piece
(the vocabulary is given with ranks, not probabilities; nothing is trained).  The probability
of a path is its weight over that of all paths.

Distinct samples come from a perturbed A-star search (Gumbel top-k): the key of a set of paths
is a Gumbel variable at the log of its probability mass, and a set's largest key is drawn
before its paths are.  The search starts with all paths under one key.  It takes the set with
the largest key, draws the path that has it, and splits the rest of the set by the first
edge at which a path leaves that one; the parts get keys at their exact masses, bounded by the key
of the set.  Masses come from backward sums, so the heuristic is exact and ``k`` rounds give the
``k`` largest keys: a sample without replacement.  The largest key left is the threshold
``kappa``; a sample's inclusion score is 1 - exp(-exp(log p - kappa)), given as its log because
whole texts have tiny probabilities.  If a text has fewer than ``k`` segmentations all are
given, with inclusion 1 where nothing is left.

Text is ``▁`` and the text, with ``▁`` for each space, cut before each space: no piece crosses
a cut, so the lattice is a chain of small lattices, built once for the distinct words of a
piece of text.  A character outside the vocabulary, and a ``▁`` of the text itself, is one edge
of its bytes.  Decoding joins the bytes of the pieces, so it returns every text exactly.

All work is inside the task that reads a text: no shuffle.  Random numbers are hashes of the
row key, the sample and the place, so results do not depend on how rows are split.

Defined results: a null or empty text has the pieces of ``▁`` alone, one segmentation; a null
doc_id seeds like 0.  Repeated rows get equal samples.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb

SAMPLES, SEED = 2, 7
#: Bytes of text whose words share one lattice: half as many as elsewhere, as a byte takes some hundred.
PIECE = 1 << 19
#: Characters of text whose paths are drawn at once.
TOGETHER = 1 << 19
#: Sets of less log mass than this get no key: that one of them holds a largest key is less likely
#: than a collision of hashes.
FAINT = -60.0
#: A piece of rank r weighs 1 / (r + FLATTEN); one byte of a character outside the vocabulary weighs BYTE.
FLATTEN, BYTE = 10.0, 1e-7
_SPACE, _OWN_MARK = 0x2581, 0x110000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Vocabulary: hashes of all prefixes of pieces, weights, and bytes for decoding."""

    _held: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_at = np.zeros(256, np.int64)
        text: dict[int, str] = {}
        content = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.bytes_at[int(model.id_to_piece(i)[1:-1], 16)] = i
                content[i] = bytes([int(model.id_to_piece(i)[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if "▁" not in piece[1:]:  # others cross a cut
                    text[i] = piece
                    content[i] = piece.replace("▁", " ").encode()
        order = sorted(text, key=lambda i: (-model.get_score(i), i))
        weight = {i: 1 / (r + FLATTEN) for r, i in enumerate(order)}
        total = sum(weight.values())
        known: dict[int, tuple[int, float]] = {}
        for i, piece in text.items():
            codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            hashes = tb.span_hash(running_hash(codes), np.zeros(len(codes), np.int64), np.arange(1, len(codes) + 1), codes)
            for h in hashes[:-1].tolist():
                known.setdefault(h, (-1, 0.0))
            known[int(hashes[-1])] = (i, float(np.log(weight[i] / total)))
        self.hashes = np.array(sorted(known), np.uint64)
        self.ids = np.array([known[int(h)][0] for h in self.hashes], np.int64)
        self.logs = np.array([known[int(h)][1] for h in self.hashes])
        # Open addressing, so that a lookup is a gather or two instead of a search.
        self.slots = np.full(1 << 20, -1, np.int32)
        for k, h in enumerate(self.hashes.tolist()):
            at = h >> 44
            while self.slots[at & 0xFFFFF] >= 0:
                at += 1
            self.slots[at & 0xFFFFF] = k
        self.longest = max(map(len, text.values()))
        self.size = np.array([len(c) for c in content], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.content = np.frombuffer(b"".join(content), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known ones, or -1."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & 0xFFFFF
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hashes[out[wrong]] != h[wrong])]
        return out

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]


def running_hash(codes: np.ndarray) -> np.ndarray:
    up, _ = tb.powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(tb.mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


def _byte_count(codes: np.ndarray) -> np.ndarray:
    c = np.where(codes == _OWN_MARK, _SPACE, codes)
    return 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)


class Lattice:
    """Edges of the distinct words of a piece of text, with the cumulated share of each at its node."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces):
        prefix = running_hash(codes)
        _, first, self.word = np.unique(tb.span_hash(prefix, start, end, codes), return_index=True, return_inverse=True)
        length = (end - start)[first]
        nodes = length + 1
        self.enter = np.cumsum(nodes) - nodes  # first node of each distinct word
        total = int(nodes.sum())
        place = np.repeat(start[first] - self.enter, nodes) + np.arange(total)  # of each node in the text
        to_end = np.repeat(self.enter + length, nodes) - np.arange(total)
        live = np.flatnonzero(to_end > 0)
        edges = []  # node, length, place of the piece among the known hashes, number among the node's edges
        single = bare = live
        degree = np.zeros(total, np.int64)
        for n in range(1, pieces.longest + 1):
            live = live[to_end[live] >= n]
            at = pieces.find(tb.span_hash(prefix, place[live], place[live] + n, codes))
            hit = at >= 0
            live, at = live[hit], at[hit]
            real = pieces.ids[at] >= 0
            from_ = live[real]
            edges.append((from_.astype(np.int32), n, at[real], degree[from_].astype(np.int16)))
            degree[from_] += 1
            if n == 1:
                bare = single[degree[single] == 0]
                degree[bare] = 1
        code = codes[place[bare]]
        del prefix, place, live, single, at, hit, real, from_
        # Edges lie by node, nodes nearest to the end of their word first.
        far = to_end.astype(np.int16 if to_end.max(initial=0) < 1 << 15 else np.int64)
        nodes_in_order = np.argsort(far, kind="stable")
        nodes_in_order = nodes_in_order[np.searchsorted(far[nodes_in_order], 1) :]
        count = degree[nodes_in_order]
        heads = np.cumsum(count) - count
        self.first = np.full(total, -1, np.int64)  # first edge of each node; -1 at the end of a word
        self.first[nodes_in_order] = heads
        self.degree = degree
        size = int(count.sum())
        self.origin, self.to, self.ids = (np.empty(size, np.int32) for _ in range(3))
        logs = np.empty(size)
        slot = self.first[bare]
        self.origin[slot], self.to[slot], self.ids[slot], logs[slot] = bare, bare + 1, -1 - code.astype(np.int64), _byte_count(code) * np.log(BYTE)
        while edges:  # one length at a time, so that edges are not held twice
            from_, n, at, nth = edges.pop()
            slot = self.first[from_] + nth
            self.origin[slot], self.to[slot], self.ids[slot], logs[slot] = from_, from_ + n, pieces.ids[at], pieces.logs[at]
        del slot, from_, at, nth
        # Backward sums.
        mass = np.zeros(total)
        depth = to_end[nodes_in_order]
        bounds = np.append(heads, len(logs))
        steps = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for a, b in zip(steps[:-1], steps[1:]):
            if b > a:
                s, e = bounds[a], bounds[b]
                mass[nodes_in_order[a:b]] = np.logaddexp.reduceat(logs[s:e] + mass[self.to[s:e]], heads[a:b] - s)
        logs += mass[self.to]
        logs -= mass[self.origin]
        self.log_share = logs
        share = np.exp(logs)
        self.upto = np.cumsum(share)
        before = self.upto[heads] - share[heads]
        del share
        self.upto -= np.repeat(before, count)
        self.upto[bounds[1:] - 1] = 2.0  # the last edge takes what rounding leaves


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((tb.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _walk(lattice: Lattice, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws a path from each node to the end of its word: (walker, edge), in order."""
    who, edges = [], []
    live = np.flatnonzero(lattice.first[node] >= 0)
    at = node[live]
    step = 0
    while len(live):
        u = _uniform(key[live] + np.uint64(step * int(_GOLD) & (1 << 64) - 1))
        edge = lattice.first[at]
        more = np.flatnonzero(u >= lattice.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= lattice.upto[edge[more]]]
        who.append(live)
        edges.append(edge)
        at = lattice.to[edge]
        on = lattice.first[at] >= 0
        live, at = live[on], at[on]
        step += 1
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, edges = np.concatenate(who), np.concatenate(edges)
    order = np.argsort(who, kind="stable")
    return who[order], edges[order]


def _gumbel(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, none above ``bound``."""
    return location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u))


class Path:
    """One sampled segmentation of every text that still has one."""

    def __init__(self, texts: int, doc: np.ndarray, word: np.ndarray, edge: np.ndarray, lattice: Lattice):
        self.edge, self.word = edge, word  # word: number of the word in the piece of text
        self.bound = np.searchsorted(doc, np.arange(texts + 1))
        run = np.concatenate([np.zeros(1), np.cumsum(lattice.log_share[edge])])
        self.log_p = run[self.bound[1:]] - run[self.bound[:-1]]
        self.before = run[:-1] - np.repeat(run[self.bound[:-1]], np.diff(self.bound))  # log mass of the path so far
        self.keys = np.full(len(edge), -np.inf)  # of the sets that leave the path at each edge


def sample_paths(
    lattice: Lattice, word: np.ndarray, doc: np.ndarray, row_key: np.ndarray, k: int
) -> tuple[list[Path], np.ndarray, np.ndarray]:
    """``k`` paths of every text, whether each exists, and the threshold of each text.

    ``word`` and ``doc``: the distinct word and the text of each word of the texts.
    """
    texts, words = len(row_key), len(doc)
    enter = lattice.enter[word]
    first_word = np.searchsorted(doc, np.arange(texts + 1))
    inside = np.arange(words) - first_word[doc]

    def key(sample: int, more: np.ndarray) -> np.ndarray:
        return tb.mix(row_key[doc] + np.uint64((sample + 1) * int(_GOLD) & (1 << 64) - 1)) + more.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    who, edge = _walk(lattice, enter, key(0, inside))
    paths = [Path(texts, doc[who], who, edge, lattice)]
    exists = np.ones((k, texts), bool)
    top = -np.log(-np.log(_uniform(tb.mix(row_key) ^ np.uint64(0xA5A5A5A5))))  # the largest key of all
    taken: dict[tuple[int, int, int], list[int]] = {}

    def split(s: int, bound: np.ndarray, since: np.ndarray, left: np.ndarray) -> None:
        """Keys for the sets that leave path ``s`` from step ``since`` of each text on."""
        path = paths[s]
        count = np.diff(path.bound)
        step = np.arange(len(path.edge)) - np.repeat(path.bound[:-1], count)
        at = np.flatnonzero((step >= np.repeat(since, count)) & (path.before > FAINT) & (lattice.degree[lattice.origin[path.edge]] > 1))
        text = np.repeat(np.arange(texts), count)[at]
        rest = 1 - np.exp(lattice.log_share[path.edge[at]])
        inherits = (step[at] == since[text]) & (left[text] >= 0)  # where the path left its set, earlier edges are gone too
        rest[inherits] = left[text[inherits]]
        at, text, rest = (x[rest > 1e-12] for x in (at, text, rest))
        u = _uniform(tb.mix(row_key[text] ^ np.uint64(s + 77)) + step[at].astype(np.uint64) * _GOLD)
        path.keys[at] = _gumbel(path.before[at] + np.log(rest), bound[text], u)

    split(0, top, np.zeros(texts, np.int64), np.full(texts, -1.0))
    for s in range(1, k + 1):
        best, of, place = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for p, path in enumerate(paths):
            for t in np.flatnonzero(np.diff(path.bound)):
                a, b = path.bound[t], path.bound[t + 1]
                at = a + int(np.argmax(path.keys[a:b]))
                if path.keys[at] > best[t]:
                    best[t], of[t], place[t] = path.keys[at], p, at
        if s == k:
            return paths, exists, best
        exists[s] = best > -np.inf
        # The path with the key: the start of path ``of``, another edge, then fresh draws.
        prefix_word, prefix_edge, prefix_doc = [], [], []
        node, since, left = enter.copy(), np.zeros(texts, np.int64), np.full(texts, -1.0)
        skip = np.zeros(words, bool)
        for t in range(texts):
            path, at = paths[of[t]], int(place[t])
            a = int(path.bound[t])
            if not exists[s, t]:
                skip[first_word[t] : first_word[t + 1]] = True
                continue
            used = taken.get((of[t], t, at), []) + [int(path.edge[at])]
            from_ = int(lattice.origin[path.edge[at]])
            choices = [e for e in range(lattice.first[from_], lattice.first[from_] + lattice.degree[from_]) if e not in used]
            shares = np.exp(lattice.log_share[choices])
            u = float(_uniform(np.array([row_key[t] ^ np.uint64(s * 1000003)], np.uint64))[0]) * shares.sum()
            pick = choices[min(int(np.searchsorted(np.cumsum(shares), u, "right")), len(choices) - 1)]
            path.keys[at] = -np.inf  # what remains of the set now belongs to the new path
            word = int(path.word[at])
            prefix_edge += [path.edge[a:at], np.array([pick])]
            prefix_word += [path.word[a:at], np.array([word])]
            prefix_doc.append(np.full(at - a + 1, t))
            skip[first_word[t] : word] = True
            node[word] = lattice.to[pick]
            since[t], left[t] = at - a, shares.sum() - np.exp(lattice.log_share[pick])
            taken[(s, t, -1)] = used
        go = np.flatnonzero(~skip)
        who, edge = _walk(lattice, node[go], key(s, inside)[go])
        who = go[who]
        all_word = np.concatenate([*prefix_word, who]).astype(np.int64)
        all_edge = np.concatenate([*prefix_edge, edge]).astype(np.int64)
        all_doc = np.concatenate([*prefix_doc, doc[who]]).astype(np.int64)
        order = np.argsort(all_doc, kind="stable")
        new = Path(texts, all_doc[order], all_word[order], all_edge[order], lattice)
        paths.append(new)
        split(s, best, since, left)
        for t in np.flatnonzero(exists[s]):
            taken[(s, t, int(new.bound[t] + since[t]))] = taken.pop((s, t, -1))
    raise AssertionError


def piece_ids(lattice: Lattice, pieces: Pieces, path: Path) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the bounds of each text; bytes stand for unknown characters."""
    ids = lattice.ids[path.edge]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, path.bound
    n = np.ones(len(ids), np.int64)
    codes = -1 - ids[bare]
    codes[codes == _OWN_MARK] = _SPACE
    raw = [chr(c).encode() for c in codes.tolist()]
    n[bare] = [len(r) for r in raw]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    out = np.repeat(ids, n)
    spread = np.concatenate([np.arange(a, b) for a, b in zip(ends[bare], ends[bare + 1])])
    out[spread] = pieces.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
    return out, ends[path.bound]


def decode(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Bytes of a run of pieces, with spaces for marks."""
    size = pieces.size[ids]
    ends = np.cumsum(size)
    at = np.repeat(pieces.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pieces.content[at]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the marked texts, and the bounds of each."""
    codes = np.frombuffer("".join(["▁" if not t else "\0" + t for t in texts]).encode("utf-32-le"), np.uint32).copy()
    bound = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts])])
    codes[codes == _SPACE] = _OWN_MARK
    codes[codes == 0x20] = _SPACE
    codes[bound[:-1]] = _SPACE
    return codes, bound


def segment(texts: list[str], row_key: np.ndarray, pieces: Pieces, k: int, together: int | None = None):
    """Texts a to b, and for each of ``k`` samples: exists, ids, bounds, log p and log inclusion.

    All texts share the lattice of their distinct words; paths are drawn for some texts at a time,
    of ``together`` characters or one text, which is what bounds the memory.
    """
    codes, bound = _codes(texts)
    start = np.flatnonzero(codes == _SPACE)
    end = np.append(start[1:], len(codes))
    doc = np.searchsorted(bound, start, "right") - 1
    lattice = Lattice(codes, start, end, pieces)
    a = 0
    while a < len(texts):
        b = len(texts) if together is None else max(int(np.searchsorted(bound, bound[a] + together, "right")) - 1, a + 1)
        lo, hi = np.searchsorted(doc, [a, b])
        paths, exists, kappa = sample_paths(lattice, lattice.word[lo:hi], doc[lo:hi] - a, row_key[a:b], k)
        out = []
        for s, path in enumerate(paths):
            ids, at = piece_ids(lattice, pieces, path)
            gap = np.where(kappa > -np.inf, path.log_p - np.where(kappa > -np.inf, kappa, 0), 700.0)
            with np.errstate(divide="ignore", over="ignore"):
                rate = np.exp(np.minimum(gap, 700))
                inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-rate)))
            out.append((exists[s], ids, at, path.log_p, np.minimum(inclusion, 0.0)))
        yield a, b, out
        a = b


def sampled_segmentations(
    docs: DataFrame, model: str, samples: int = SAMPLES, seed: int = SEED, text: str = "text", key: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """(doc_id, sample, n_pieces, ids_crc32, log_p, log_inclusion, decodes[, ids]): up to ``samples`` rows a document."""
    schema = "doc_id bigint, sample int, n_pieces bigint, ids_crc32 bigint, log_p double, log_inclusion double, decodes boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for part, data, offs in tb.pieces(batches, "text", PIECE):
            texts = [t or "" for t in tb.column(part, "text").to_pylist()]
            ids_of = tb.column(part, "doc_id")
            row_key = tb.mix(ids_of.fill_null(0).to_numpy().view(np.uint64) + np.uint64(seed * int(_GOLD) & (1 << 64) - 1))
            drawn = ((a, s, *one) for a, _, out in segment(texts, row_key, pieces, samples, TOGETHER) for s, one in enumerate(out))
            for a, s, exists, ids, at, log_p, inclusion in drawn:
                keep = np.flatnonzero(exists)
                raw = ids.astype("<i4")
                back = decode(ids, pieces)
                size = np.concatenate([np.zeros(1, np.int64), np.cumsum(pieces.size[ids])])
                same = [np.array_equal(back[size[at[t]] + 1 : size[at[t + 1]]], data[offs[a + t] : offs[a + t + 1]]) for t in keep]
                own = [raw[at[t] : at[t + 1]] for t in keep]
                cols = [
                    ids_of.take(pa.array(a + keep)), pa.array(np.full(len(keep), s, np.int32)), pa.array((at[1:] - at[:-1])[keep]),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()), pa.array(np.round(log_p[keep], 6)),
                    pa.array(np.round(inclusion[keep], 6)), pa.array(same, pa.bool_()),
                ]
                names = [c.strip().split()[0] for c in schema.split(",")]
                if with_ids:
                    cols.append(pa.array(own, pa.list_(pa.int32())))
                    names = [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
