"""Packing documents into fixed-length sequences with a grouping genetic algorithm.

Documents are tokenised, closed with an end id and, where longer than a
sequence, cut so that every piece but the first is a full sequence.  Full pieces
are sequences of their own.  The others are packed by islands: each island
holds a bounded share of the pieces and a population of packings made by best
fit.  Crossover injects whole well-filled bins of one packing into another,
removes the bins there that hold the same pieces, and puts the displaced pieces
back by best fit.  Between epochs an island's full bins are settled, except for
a share of its best ones: these elites migrate as whole bins, together with the
pieces of bins that are not full, to other and fewer islands, until one island
settles the rest.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, tidy

ISLAND = 16_384
"""Pieces of an island, about: islands are dealt by hash."""


SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""Fixed value: the pre-tokeniser's pattern of byte-level BPE vocabularies of this kind."""


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, with a bounded cache of words.

    Reads a ``tokenizers`` file of a byte-level BPE and gives the ids that
    library gives with ``add_special_tokens=False``: none are put around a text, and the name of an added
    token within it is that token.  The merging itself is left to
    ``tiktoken``, whose ranks are the vocabulary's ids, as it needs a fraction of
    the time.  The pre-tokeniser always starts a new token at a single space
    between non-space runs, so such chunks are encoded apart and remembered.
    Texts with other runs of spaces are encoded whole.
    """

    def __init__(self, path: str, limit: int = 200_000):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=lambda k: (-len(k), k))))) if special else None
        names = byte_names()
        ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("chartloom", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.single = bpe.encode_ordinary, bpe._encode_single_piece
        self.limit = limit
        self.inner: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _around(self, text: str) -> bytes:
        """Ids of a text that names added tokens."""
        at, out = 0, []
        for m in self.cut.finditer(text):
            out += [self._ids(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join(out) + self._ids(text[at:])

    def _word(self, p: str) -> bytes:
        """Ids of a space and a chunk; letters alone, or with one mark after them, need no splitting."""
        if p.isalpha():
            return np.array(self.single((" " + p).encode()), "<u4").tobytes()
        if p[:-1].isalpha() and p[-1] in ".,;:!?":
            head = self.inner.get(p[:-1])
            return (self._word(p[:-1]) if head is None else head) + self._ids(p[-1])
        return self._ids(" " + p)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > self.limit:
            self.inner.clear()
        inner, ids, word, out = self.inner, self._ids, self._word, []
        get = inner.__getitem__
        for t in texts:
            if self.cut and self.cut.search(t):
                out.append(self._around(t))
                continue
            parts = t.split(" ")
            if "" in parts:
                out.append(ids(t))
                continue
            head, rest = parts[0], parts[1:]
            for p in set(rest).difference(inner):
                inner[p] = word(p)
            out.append(ids(head) + b"".join(map(get, rest)))
        return out


def _pieces(path: str, capacity: int, end: bytes):
    schema = pa.schema([("salt", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, salt = Encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 500):
                for doc, raw in zip(ids[a : a + 500], encode([t or "" for t in texts[a : a + 500]])):
                    raw += end
                    n = len(raw) // 4
                    cut = n % capacity or capacity
                    edges = [0, *range(cut, n + 1, capacity)]
                    for k in range(len(edges) - 1):
                        salt += 1
                        out.append((salt, doc, k, edges[k], edges[k + 1] - edges[k], zlib.crc32(raw[4 * edges[k] : 4 * edges[k + 1]])))
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run, "salt long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Best fit by residual space: a bit mask says which residuals some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.left = capacity, [], []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], left: int) -> None:
        self.items.append(items)
        self.left.append(left)
        self.by_left[left].append(len(self.items) - 1)
        self.mask |= 1 << left

    def put(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.add([item], self.capacity - length)
            return
        left = length + (fits & -fits).bit_length() - 1
        stack = self.by_left[left]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << left
        self.items[b].append(item)
        left -= length
        self.left[b] = left
        self.by_left[left].append(b)
        self.mask |= 1 << left

    def refill(self, b: int, left: int) -> None:
        """Bin ``b`` has so much space now."""
        stack = self.by_left[self.left[b]]
        stack.remove(b)
        if not stack:
            self.mask ^= 1 << self.left[b]
        self.left[b] = left
        self.by_left[left].append(b)
        self.mask |= 1 << left

    def score(self) -> float:
        """Mean squared fill: many full bins and few empty ones count as better."""
        return sum((1 - x / self.capacity) ** 2 for x in self.left) / max(1, len(self.left))


def best_fit(order: list[int], lengths: list[int], bins: Bins) -> Bins:
    for i in order:
        bins.put(i, lengths[i])
    return bins


def crossover(giver: Bins, taker: Bins, lengths: list[int], share: float, rng: random.Random) -> Bins:
    """The taker's packing with whole well-filled bins of the giver."""
    fullest = sorted(range(len(giver.left)), key=lambda b: (giver.left[b], rng.random()))
    chosen = fullest[: max(1, int(len(fullest) * share))]
    taken = {i for b in chosen for i in giver.items[b]}
    child, loose = Bins(giver.capacity), []
    for b in chosen:
        child.add(list(giver.items[b]), giver.left[b])
    for items, left in zip(taker.items, taker.left):
        if taken.isdisjoint(items):
            child.add(list(items), left)
        else:
            loose.extend(i for i in items if i not in taken)
    return best_fit(sorted(exchange(child, loose, lengths), key=lambda i: -lengths[i]), lengths, child)


def exchange(bins: Bins, loose: list[int], lengths: list[int]) -> list[int]:
    """Fills bins by putting a longer displaced piece in the place of a shorter one; returns the pieces displaced then."""
    loose = sorted(loose, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in loose]
    for b in range(len(bins.items)):
        if not loose:
            break
        items, left = bins.items[b], bins.left[b]
        if not left:
            continue
        best = (0, 0, 0)
        for k, i in enumerate(items):
            at = bisect_right(sizes, lengths[i] + left) - 1
            if at >= 0:
                best = max(best, (sizes[at] - lengths[i], k, at))
        gain, k, at = best
        if gain > 0:
            out, items[k] = items[k], loose.pop(at)
            sizes.pop(at)
            at = bisect_right(sizes, lengths[out])
            loose.insert(at, out)
            sizes.insert(at, lengths[out])
            bins.refill(b, left - gain)
    return loose


def evolve(lengths: list[int], capacity: int, elites: list[list[int]], seed: int, population: int = 8, generations: int = 16) -> Bins:
    """The best packing found; ``elites`` are bins that came whole from other islands.

    Packings with fewer bins are better, and of these such with fuller bins: the space that is left
    gathers in few bins, whose pieces migrate.  Generations end early where all bins but one are full.
    """
    rng = random.Random(seed)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [best_fit(down, lengths, Bins(capacity))]
    if elites:
        whole, kept = Bins(capacity), {i for e in elites for i in e}
        for e in elites:
            whole.add(list(e), capacity - sum(lengths[i] for i in e))
        people.append(best_fit([i for i in down if i not in kept], lengths, whole))
    while len(people) < population:
        noise = [lengths[i] * rng.uniform(0.7, 1.3) for i in range(len(lengths))]
        people.append(best_fit(sorted(down, key=lambda i: -noise[i]), lengths, Bins(capacity)))
    rank = lambda b: (len(b.left), -b.score())
    for _ in range(generations):
        people.sort(key=rank)
        if sum(x > 0 for x in people[0].left) <= 1:
            break
        # A tournament of two for either parent.
        a, b = (min(rng.sample(range(len(people)), 2)) for _ in range(2))
        child = crossover(people[a], people[b if b != a else (a + 1) % len(people)], lengths, rng.uniform(0.2, 0.7), rng)
        if rank(child) < rank(people[-1]):
            people[-1] = child
    return min(people, key=rank)


def _island(capacity: int, epoch: int, last: bool, settle: float, migrate: int):
    schema = pa.schema([("salt", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("salt")
        salts, lengths, group = (table.column(c).to_pylist() for c in ("salt", "length", "bin"))
        island = table.column("island")[0].as_py()
        whole: dict[int, list[int]] = {}
        for i, g in enumerate(group):
            if g is not None:
                whole.setdefault(g, []).append(i)
        best = evolve(lengths, capacity, list(whole.values()), 1_000_003 * epoch + island)
        full = sorted((left, b) for b, left in enumerate(best.left) if last or left <= capacity * (1 - settle))
        elite = set() if last else {b for _, b in full[:: max(1, migrate)][: len(full) // max(1, migrate)]}
        done = {b for _, b in full} - elite
        rows = []
        for b, items in enumerate(best.items):
            name, at = ((epoch + 1) << 56) | (island << 24) | b, 0
            for i in items:
                rows.append((salts[i], lengths[i], name if b in done or b in elite else None, at, b in done))
                at += lengths[i]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, schema.types)], schema=schema)

    return run, "salt long, length long, bin long, offset long, done boolean"


class SequencePacker:
    """Packs tokenised documents into sequences of at most ``capacity`` tokens.

    A null text is empty and makes one piece that holds the end id alone.  Ids
    may be null or repeat; each row is a document.  Columns beside id and text
    are ignored.  An empty table gives an empty result.  Every piece gets one
    place; places in a sequence are gapless.  Sequences of one full piece have negative numbers.
    """

    def __init__(self, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", settle: float = 0.998, migrate: int = 16):
        self.path, self.capacity, self.end = tokenizer_path, capacity, int(end_id).to_bytes(4, "little")
        self.id_col, self.text_col, self.settle, self.migrate = id_col, text_col, settle, migrate

    def pieces(self, docs: DataFrame) -> DataFrame:
        run, schema = _pieces(self.path, self.capacity, self.end)
        return docs.select(F.col(self.id_col).cast("long"), F.col(self.text_col)).mapInArrow(tidy(run), schema)

    def pack(self, docs: DataFrame) -> DataFrame:
        """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
        scratch = Scratch(docs.sparkSession)
        pieces = scratch.keep(self.pieces(docs), "pieces")
        settled = pieces.where(F.col("length") == self.capacity).select("salt", (-F.col("salt") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        now = pieces.where(F.col("length") < self.capacity).select("salt", "length", F.lit(None).cast("long").alias("bin"))
        n, epoch, before = now.count(), 0, None
        while n:
            islands = -(-n // ISLAND)
            last = islands == 1 or (before is not None and islands > 0.7 * before)
            dealt = now.withColumn("island", F.pmod(F.xxhash64(F.coalesce("bin", "salt"), F.lit(epoch)), F.lit(islands)))
            run, schema = _island(self.capacity, epoch, last, self.settle, self.migrate)
            placed = scratch.keep(dealt.groupBy("island").applyInArrow(run, schema), f"epoch{epoch}")
            settled = settled.union(placed.where("done").select("salt", F.col("bin").alias("sequence_id"), "offset"))
            now = placed.where("not done").select("salt", "length", "bin")
            n, epoch, before = 0 if last else now.count(), epoch + 1, islands
        return pieces.join(settled, "salt").drop("salt")
