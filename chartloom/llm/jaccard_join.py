"""Exact set-similarity join on word n-grams by universe partitioning.

The shingle universe is hashed into ``m`` segments.  Two sets with Jaccard
similarity t or more and sizes a <= b differ in at most d shingles, so with
d + 1 segments one segment at least is the same in both (pigeonhole).  Each
set therefore publishes, for its size band and for the band below it, one
signature for each of the band's segments, and sets meet where signatures do.

* **Size bands.**  A band holds the sizes [lo, hi] with hi = floor(lo / t): the
  larger set of a pair lies in the band of the smaller one or in the next.
* **Allocation.**  A segment can be read *exactly* (its signature counts one
  difference) or with its *one-deletion neighbourhood* (the segment less
  each one of its shingles; counts two, for about one signature a shingle).
  ``plan_need`` picks for each band the numbers of the two kinds that satisfy
  the pigeonhole bound at the least cost: signatures made, plus the sets that a set
  meets there, ``PAIRED`` at most, as larger buckets are split.  How many it meets is measured over all texts: the first pass
  counts how many sets share a segment of 1/2, 1/4, ... 1/64 of the universe.
  Exact segments can come with *spare*
  ones: with s more than needed, linked sets share s + 1 segments, and so one
  that is not empty if either has at most s empty ones; a set that does then
  publishes no empty segments, in which all sets would meet.
* **Verification.**  Sets that meet are compared whole.

Groups of copies never become all pairs.  Equal sets are one node.  In a bucket
of equal signatures each set is compared with the bucket's least set; what is
one component then needs no more comparing.  Of a bucket that still holds several
components, members are paired if that makes few pairs a row (``PAIRED``).  Larger ones are split by what
tells their members apart.  M, the shingles that most of a few members have, is about the text that was
copied and edited; a set S becomes its difference D = S xor M, mostly edits of its own.
D xor D' = S xor S', so that sets which link have a known least number of shingles in common in
their differences, and each need meet others only in a prefix of its D, shingles that M lacks first
(``prefixes``).  The prefixes make smaller buckets, which are treated in
the same way until none is large.  No link between different components is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as W
from .components import connected
from .scratch import Scratch, tidy


def max_partner(size: int, percent: int) -> int:
    """The largest set size that can link with a set of ``size``."""
    return size * 100 // percent


def max_difference(a: int, b: int, percent: int) -> int:
    """The most shingles in which linked sets of sizes a and b can differ.

    100 i >= p (a + b - i) gives i >= p (a + b) / (100 + p), and they differ in
    a + b - 2 i.
    """
    least = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * least


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest size of each band, in order, up to one that holds ``upto``."""
    low, high = [1], [max_partner(1, percent)]
    while high[-1] < upto:
        low.append(high[-1] + 1)
        high.append(max_partner(low[-1], percent))
    return np.array(low), np.array(high)


MEET_COST = 12.0
"""Cost of a set met in a bucket, in signatures: rows more are sorted, made distinct and joined with sketches."""

PROBES = 6
"""The halvings of the universe at which meetings are measured."""


class Meetings:
    """How many other sets of its size band a set meets in one segment of so many shingles, as measured.

    ``met[r - 1]`` is that number for a segment that is 2^-r of the universe, not counting empty ones;
    ``sets`` is the number of sets in the band.
    """

    def __init__(self, low: int, sets: float = 0.0, met: tuple[float, ...] = (0.0,) * PROBES):
        self.sets = sets
        # Fewer shingles agree at least as often.
        self.met = np.maximum.accumulate(np.maximum(np.array(met, float), 1e-9))
        self.tokens = low / 2.0 ** np.arange(1, PROBES + 1)

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(-np.log(tokens), -np.log(self.tokens), np.log(self.met)))

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Sets that agree in all shingles of the segment but one, when each agrees with a chance that does not depend on the others."""
        half = np.maximum(self.exact(tokens / 2), 1e-9)
        rho = np.clip((self.exact(tokens) / half) ** (2 / np.maximum(tokens, 1e-9)), 0.05, 1)
        return np.minimum(self.exact(tokens) * (1 + tokens * (1 - rho) / rho), np.maximum(half, self.exact(tokens)))


def plan_need(low: int, need: int, meetings: Meetings | None = None) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, spare segments) that bear ``need`` - 1 differences at the least cost."""
    meetings = meetings or Meetings(low)
    # Exact segments, some of them spare.
    spare = np.arange(need + 9)
    m = need + spare
    tokens = low / m
    empty = np.exp(-tokens)
    mean = m * empty
    # The chance of more empty segments than spare ones, as of a normal distribution.
    holes = np.array([math.erfc((s + 0.5 - x) / math.sqrt(2 * x + 1e-12)) / 2 for s, x in zip(spare, mean)])
    cost = m + MEET_COST * m * (meetings.exact(tokens) + meetings.sets * empty * empty * holes)
    k = int(np.argmin(cost))
    best = float(cost[k]), int(m[k]), 0, int(spare[k])
    # Some read with their one-deletion neighbourhoods.
    near = np.arange(1, need // 2 + 1)
    if len(near):
        single = need - 2 * near
        tokens = low / (single + near)
        empty = np.exp(-tokens)
        meet = single * (meetings.exact(tokens) + meetings.sets * empty**2) + near * (meetings.near(tokens) + meetings.sets * (empty * (1 + tokens)) ** 2)
        cost = single + near * (tokens + 1) + MEET_COST * meet
        k = int(np.argmin(cost))
        best = min(best, (float(cost[k]), int(single[k]), int(near[k]), 0))
    return best[1:]


def plan_band(low: int, high: int, percent: int, meetings: Meetings | None = None) -> tuple[int, int, int]:
    """The plan for pairs whose smaller set is in the band."""
    # What two sets can differ in grows with their sizes, but for rounding.
    worst = max(max_difference(a, b, percent) for a in range(max(low, high - 20), high + 1) for b in range(max(a, max_partner(a, percent) - 20), max_partner(a, percent) + 1))
    return plan_need(low, worst + 1, meetings)


Plans = tuple[np.ndarray, np.ndarray, np.ndarray]


def plans(percent: int, upto: int, measured: dict[int, tuple[float, tuple[float, ...]]] | None = None) -> Plans:
    """(exact, one-deletion, spare segments) by band; ``measured``: sets and meetings by band."""
    low, high = bands(percent, upto)
    of = lambda i, a: Meetings(a, *measured[i]) if measured and i in measured else None
    return tuple(np.array(x) for x in zip(*(plan_band(int(a), int(b), percent, of(i, int(a))) for i, (a, b) in enumerate(zip(low, high)))))


def shingle_sets(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the n + 1 offsets of the texts.

    A text of fewer than n words has its whole word sequence as one shingle,
    one without words has none.
    """
    hashes, inside = w.windows(n)
    count = np.diff(w.first)
    place = np.flatnonzero(inside)
    owner = np.searchsorted(w.first, place, "right") - 1
    value = hashes[place]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([int(W.mix(np.array([int(np.bitwise_xor.reduce(W.mix(w.hashes[w.first[d] : w.first[d + 1]] + np.arange(count[d], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))))], np.uint64), 77)[0]) for d in short], np.uint64)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, extra])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    ends = np.searchsorted(owner, np.arange(len(count) + 1))
    for d in range(len(count)):
        value[ends[d] : ends[d + 1]].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def set_identity(value: np.ndarray, ends: np.ndarray, salt: int = 11) -> np.ndarray:
    """A 64-bit identity of each set that does not depend on order."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(value, salt))])
        return W.mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64), salt + 1)


def identities(value: np.ndarray, ends: np.ndarray, clash: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(node, twin): identities of 64 bits each; ``clash`` has the nodes that several sets have, and the least twin there.

    Sets of such a node with another twin are named by both, so that sets are told apart by 128 bits.
    """
    node, twin = set_identity(value, ends).view(np.int64), set_identity(value, ends, 13).view(np.int64)
    if clash:
        for i in np.flatnonzero(np.isin(node, list(clash))):
            if clash[int(node[i])] != twin[i]:
                node[i] = W.mix(node[i : i + 1].view(np.uint64) ^ W.mix(twin[i : i + 1].view(np.uint64), 15), 16).view(np.int64)[0]
    return node, twin


SKETCH_LONGS = 4
"""64-bit words of a parity sketch."""
SKETCH = [f"k{i}" for i in range(SKETCH_LONGS)]


WIDE_LONGS = 64
"""64-bit words of the wide sketch that pairs are compared by before their sets are."""


def parity_sketch(value: np.ndarray, ends: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """Bits that say for each hash class whether a set has an odd number of shingles there.

    A shingle that only one of two sets has flips one bit, so the sketches
    differ in at most as many bits as the sets differ in shingles: a bound that
    rules out pairs and never loses one.
    """
    bit = W.mix(value, 31) & np.uint64(longs * 64 - 1)
    out = np.zeros((len(ends) - 1, longs), np.uint64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    np.bitwise_xor.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def signatures(value: np.ndarray, owner: np.ndarray, size: np.ndarray, band: np.ndarray, plan: Plans) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of sets under the plans of the given bands; one band for each set."""
    exact, near, spares = plan
    with np.errstate(over="ignore"):
        singles, segments = exact[band], (exact + near)[band]
        base = np.concatenate([[0], np.cumsum(segments)])
        spread = W.mix(value, 21) >> np.uint64(32)
        inner = ((spread * segments[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        at = base[owner] + inner
        print_ = W.mix(value, 22)
        low = np.bincount(at, (print_ & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
        high = np.bincount(at, (print_ >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
        whole = low + (high << np.uint64(32))
        who = np.repeat(np.arange(len(size)), segments)
        number = np.arange(base[-1]) - base[who]
        key = W.mix((band[who].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64), 23)
        # A set with no more empty segments than spare ones shares one that is not empty with each partner.
        empty = np.bincount(at, minlength=base[-1]) == 0
        holes = np.bincount(who[empty], minlength=len(size))
        made_who, made = [who], [W.mix(whole + key, 24)]
        show = ~(empty & ((spares[band] > 0) & (holes <= spares[band]))[who])
        made_who, made = [who[show]], [made[0][show]]
        fuzzy = inner >= singles[owner]
        if fuzzy.any():
            made_who.append(owner[fuzzy])
            made.append(W.mix(whole[at[fuzzy]] - print_[fuzzy] + key[at[fuzzy]], 24))
    return np.concatenate(made_who), np.concatenate(made)


def probes(value: np.ndarray, ends: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, print) of what each set has in the first 1/2, 1/4, ... of the universe, where it has anything."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    spread, print_ = W.mix(value, 21), W.mix(value, 25)
    who, made = [], []
    for r in range(1, PROBES + 1):
        inside = spread < np.uint64(1 << (64 - r))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, print_, np.uint64(0)))])
        count = np.bincount(owner[inside], minlength=len(ends) - 1)
        some = np.flatnonzero(count)
        whole = W.mix(total[ends[1:]] - total[ends[:-1]] + (band.astype(np.uint64) << np.uint64(8)), 26)[some]
        who.append(some)
        # The lowest bits say which halving it is.
        made.append((whole << np.uint64(3)) | np.uint64(r))
    who, made = np.concatenate(who), np.concatenate(made)
    order = np.argsort(who, kind="stable")
    return who[order], made[order]


def _lists(who: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list array of n rows; ``who`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _describe(shingle: int, percent: int):
    names = ["doc_id", "rid", "size", "node", "twin", "band", *SKETCH, "wide", "probes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.rows(batch, "text", lower=True):
                value, ends = shingle_sets(w, shingle)
                size = np.diff(ends)
                node, twin = identities(value, ends, {})
                low, _ = bands(percent, 1 << int(size.max(initial=1)).bit_length())
                band = np.maximum(np.searchsorted(low, size, "right") - 1, 0)
                sketch, wide = parity_sketch(value, ends), parity_sketch(value, ends, WIDE_LONGS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("rid").slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(node), pa.array(twin), pa.array(band.astype(np.int32)),
                     *(pa.array(x) for x in sketch.T), pa.array([x.tobytes() for x in wide], pa.binary()), _lists(*probes(value, ends, band), b - a)], names=names,
                )

    return run, "doc_id long, rid long, size long, node long, twin long, band int, " + "".join(f"{k} long, " for k in SKETCH) + "wide binary, probes array<long>"


def _publish(shingle: int, percent: int, upto: int, plan: Plans, clash: dict[int, int]):
    """Signatures of the sets of texts, once for each set that a task meets."""
    low, _ = bands(percent, upto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, w in W.rows(batch, "text", lower=True):
                value, ends = shingle_sets(w, shingle)
                size = np.diff(ends)
                node, _ = identities(value, ends, clash)
                fresh = np.zeros(len(size), bool)
                for i, x in enumerate(node.tolist()):
                    if size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                band = np.maximum(np.searchsorted(low, size, "right") - 1, 0)
                owner = np.repeat(np.arange(len(size)), size)
                who, sig = [], []
                for step in (0, 1):
                    keep = fresh & (band >= step)
                    use = keep[owner]
                    number = np.cumsum(keep) - 1
                    o, x = signatures(value[use], number[owner[use]], size[keep], band[keep] - step, plan)
                    who.append(np.flatnonzero(keep)[o])
                    sig.append(x)
                who, sig = np.concatenate(who), np.concatenate(sig)
                order = np.argsort(who, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), _lists(who[order], sig[order], len(size))], names=["node", "size", "sigs"])

    return run, "node long, size long, sigs array<long>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and node: those whose signature another node has too, with the least node.

    Rows stream by; of a bucket only the least node is held.
    """
    names = ["sig", "node", "size", "lead"]
    held: tuple | None = None  # the last row so far, and whether it was the first of its signature
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            sig, node, size = np.concatenate([held[0], sig]), np.concatenate([held[1], node]), np.concatenate([held[2], size])
        start = np.ones(len(sig), bool)
        start[1:] = sig[1:] != sig[:-1]
        lead = node[np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))]
        same = np.zeros(len(sig), bool)
        same[1:] = (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])
        many = (node != lead) & ~same
        # The least node of a bucket is put out beside its first other node.
        first = np.zeros(len(sig), bool)
        at = np.flatnonzero(many)
        if len(at):
            _, pick = np.unique(sig[at], return_index=True)
            first[at[pick]] = True
        if held is not None:
            old = held[3]
            first &= ~((sig == sig[0]) & old)
        heads = np.flatnonzero(first)
        head_at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))[heads]
        out = np.concatenate([at, head_at])
        many_last = bool(many[sig == sig[-1]].any()) or bool(held is not None and held[3] and sig[-1] == sig[0])
        k = int(np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))[-1])
        held = sig[[k]], node[[k]], size[[k]], many_last
        yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(node[out]), pa.array(size[out]), pa.array(lead[out])], names=names)


def _sets(shingle: int, clash: dict[int, int]):
    """(node, items) of the texts whose set is the node asked for: hashes of rows may clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("node").to_numpy()
            for a, b, w in W.rows(batch, "text", lower=True):
                value, ends = shingle_sets(w, shingle)
                node, _ = identities(value, ends, clash)
                flat = value.tobytes()
                at = np.flatnonzero(node == asked[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([flat[8 * ends[i] : 8 * ends[i + 1]] for i in at], pa.binary())], names=["node", "items"])

    return run, "node long, items binary"


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left_items"), batch.column("right_items")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _possible(percent: int):
    """Pairs whose wide sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE_LONGS) for c in ("left_wide", "right_wide"))
            both = batch.column("left_size").to_numpy() + batch.column("right_size").to_numpy()
            most = both - 2 * -(-percent * both // (100 + percent))
            fine = pa.array(np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= most)
            yield batch.select(["a", "b"]).filter(fine)

    return run


PAIRED = 64
"""Pairs for each row up to which a bucket's sets are compared with each other: 129 members that all may pair."""
LINKED, CORE, MIDDLE, REST = 0, 1, 2, 3
"""Ranks of a row of a bucket, see ``prefixes``.  Rows pair that are linked and not, core and core, core and middle."""
VOTES = 15
"""Members, those with the least hashes, whose majority is taken for the text that was copied; results do not depend on it."""


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, partner) for the partners from ``first`` to before ``end`` of each row."""
    count = np.maximum(end - first, 0)
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _cross(percent: int):
    """Pairs of rows of a bucket in different components that may link.

    Rows are sorted by bucket and there by ``rank``.  Rows stream by; of a bucket only those are held
    that others pair with.
    """
    names = ["sig", "node", "size", "root", "rank", "over", *SKETCH]

    def likely(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, ordered: bool) -> np.ndarray:
        ok = t["root"][i] != t["root"][j]
        if ordered:
            ok &= t["over"][i] <= t["over"][j]
        i, j = i[ok], j[ok]
        a, b = t["size"][i], t["size"][j]
        ok = np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
        differ = sum(np.bitwise_count(t[k][i] ^ t[k][j]).astype(np.int64) for k in SKETCH)
        ok &= differ <= a + b - 2 * -(-percent * (a + b) // (100 + percent))
        a, b = t["node"][i[ok]], t["node"][j[ok]]
        return np.stack([np.maximum(a, b), np.minimum(a, b)], 1)

    def pairs(t: dict[str, np.ndarray], old: int) -> pa.RecordBatch:
        """``old`` rows at the start have been paired with each other."""
        n = len(t["sig"])
        start = np.flatnonzero(np.concatenate([[True], t["sig"][1:] != t["sig"][:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        # Where the ranks begin in each bucket.
        edge = start[:, None] + np.concatenate([np.zeros((len(start), 1), np.int64), np.cumsum(np.stack([np.bincount(group, t["rank"] == r, len(start)) for r in range(4)], 1), 1).astype(np.int64)], 1)
        edge = edge[group]
        linked, core = np.flatnonzero(t["rank"] == LINKED), np.flatnonzero(t["rank"] == CORE)
        found = [np.zeros((0, 2), np.int64)]
        for rows, first, last, ordered in ((linked, edge[linked, 1], edge[linked, 4], False), (core, core + 1, edge[core, 2], False), (core, edge[core, 2], edge[core, 3], True)):
            first = np.maximum(first, old)
            total = np.concatenate([[0], np.cumsum(np.maximum(last - first, 0))])
            # In parts of about so many pairs, however many rows a bucket has.
            cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + 1, 200_000), "left").clip(0, len(rows)))
            for x, y in zip(cuts, np.append(cuts[1:], len(rows))):
                i, j = _ranges(first[x:y], last[x:y])
                found.append(likely(t, rows[x:y][i], j, ordered))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        carry: dict[str, np.ndarray] | None = None
        # Buckets of one lead come in a row: the same pairs meet in many of them, and are put out once.
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            if not rows or (batch is not None and rows < 50_000):
                continue
            t = {c: np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in names}
            t |= {k: t[k].view(np.uint64) for k in SKETCH}
            old = len(carry["sig"]) if carry else 0
            if carry:
                t = {c: np.concatenate([carry[c], x]) for c, x in t.items()}
            yield pairs(t, old)
            keep = (t["sig"] == t["sig"][-1]) & (t["rank"] <= CORE)
            carry, held, rows = {c: x[keep] for c, x in t.items()}, [], 0

    return run


def difference(items: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that only one of two sets has, in an order common to all sets: those that the centre lacks first."""
    both = np.concatenate([items, centre])
    order = np.argsort(both, kind="stable")
    value, mine = both[order], order < len(items)
    alone = np.ones(len(both), bool)
    same = value[1:] == value[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    own, other = W.mix(value[alone & mine], 27), W.mix(value[alone & ~mine], 28)
    own.sort()
    other.sort()
    return np.concatenate([own, other])


def excess(differ: int, size: int, percent: int) -> int:
    """How far a set is from the centre beyond what its size allows, in units of 1 / (100 + percent)."""
    return (100 + percent) * differ - (100 - percent) * size


def prefixes(own: tuple[np.ndarray, int], pivot: tuple[np.ndarray, int], percent: int) -> tuple[bool, list[int]]:
    """(set links with pivot, ends of the prefixes by which it meets others: linked, core, middle, rest).

    Both are given as (difference from the centre, size); the pivot is the set of the group with the least excess.
    With c = (100 - p) / (100 + p), differences of x and y shingles and sizes a and b, sets link when
    x + y - 2 common <= c (a + b), so that common >= (e + f) / 2 with the excesses e = x - c a and f = y - c b.
    Sets with k shingles in common meet in the first x - k + 1 and y - k + 1 of a common order.
    No f is below that of the pivot, g; and one of a set that does not link with the pivot is above -g.  So
    one that links with the pivot meets those that do not by k = (e + |g|) / 2, and is met by k = (e + g) / 2; of two
    that do not, that with the smaller excess meets the other by k = e too, and is met by k = (e + |g|) / 2.
    """
    n, unit = len(own[0]), 100 + percent
    apart = n + len(pivot[0]) - 2 * int(np.isin(own[0], pivot[0], assume_unique=True).sum())
    linked = unit * apart <= (100 - percent) * (own[1] + pivot[1])
    e, g = excess(n, own[1], percent), excess(len(pivot[0]), pivot[1], percent)
    # The least whole numbers of common shingles not below e, (e + |g|) / 2 and (e + g) / 2.
    k0, k1, k2 = -(-e // unit), -(-(e + abs(g)) // (2 * unit)), -(-(e + g) // (2 * unit))
    ends = [n - max(1, k) + 1 for k in (max(k0, k1), k1, k2)]
    return linked, [max(0, ends[1]), 0, 0, 0] if linked else [0, *(max(0, x) for x in ends)]


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that more than half of the sets in a list have."""
    for batch in batches:
        out = []
        for some in batch.column("some"):
            value, count = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in some.values]), return_counts=True)
            out.append(value[2 * count > len(some.values)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lead"), pa.array(out, pa.binary())], names=["lead", "centre"])


def _differ(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(difference(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), len(x.as_buffer()) // 8) for x, y in zip(batch.column("items"), batch.column("centre"))]
            size, over = [n for _, n in found], [excess(len(d), n, percent) for d, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead"), pa.array(size, pa.int64()), pa.array(over, pa.int64()), pa.array([d.tobytes() for d, _ in found], pa.binary())], names=["node", "lead", "size", "over", "differ"])

    return run, "node long, lead long, size long, over long, differ binary"


def _cut(percent: int):
    names = ["node", "lead", "pivot", "over", "linked", "keys", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = W.mix(batch.column("lead").to_numpy().view(np.uint64), 29)
            links, keys, marks = [], [], []
            for i, row in enumerate(zip(batch.column("differ"), batch.column("size").to_pylist(), batch.column("pivot_differ"), batch.column("pivot_size").to_pylist())):
                own, pivot = np.frombuffer(row[0].as_buffer(), np.uint64), np.frombuffer(row[2].as_buffer(), np.uint64)
                linked, ends = prefixes((own, row[1]), (pivot, row[3]), percent)
                n = max(ends)
                links.append(linked)
                keys.append(W.mix(own[:n] ^ salt[i], 30).view(np.int64))
                marks.append(np.searchsorted(np.maximum.accumulate(ends), np.arange(n), "right").astype(np.int8))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead"), batch.column("pivot"), batch.column("over"), pa.array(links, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int8()))], names=names)

    return run, "node long, lead long, pivot long, over long, linked boolean, keys array<long>, marks array<tinyint>"


class NgramJaccardJoin:
    """Components of texts whose word-shingle sets are alike, found exactly.

    ``shingle`` words make a shingle; sets link when ``100 * intersection >=
    percent * union``.  A null or blank text has an empty set and links with
    nothing.  Every row is a text of its own, whatever its id: ids may be null or repeat; a
    component is named by the least id in it that is not null.  Other columns of ``docs`` are
    ignored by ``components`` and kept by ``deduplicate``, whatever their names.
    An empty table gives an empty result.
    """

    def __init__(self, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.shingle, self.percent, self.id_col, self.text_col = shingle, percent, id_col, text_col

    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row for each row: component_id is the least id reachable by links."""
        scratch = Scratch(docs.sparkSession)
        named = self._named(docs, scratch).select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("root", "node")).alias("root"))
        some = named.where("root is not null")
        least = scratch.keep(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        out = some.join(least, "root").select("doc_id", "n_shingles", "component_id")
        return out.union(named.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """``docs`` with one row of each component: that with the least id, a null id last; of equal rows one.

        Rows without words are in no component and stay.
        """
        scratch = Scratch(docs.sparkSession)
        named = self._named(docs, scratch).where("size > 0").select("rid", "doc_id", F.coalesce("root", "node").alias("root"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best")
        many = scratch.keep(named.groupBy("root").agg(best, F.count("*").alias("rows")).where("rows > 1").select(F.col("root").alias("r"), F.col("best.rid").alias("stay")), "many")
        ruled = named.join(many, F.expr("root = r")).select("rid", (F.col("rid") == F.col("stay")).alias("stay")).distinct()
        ruled = scratch.keep(ruled, "ruled")
        return self._ruled(docs, ruled)

    def _ruled(self, docs: DataFrame, ruled: DataFrame) -> DataFrame:
        n = next(n for n in range(1, 99) if not any(c.lower().startswith("_" * n + "rid") for c in docs.columns))
        rid = "_" * n + "rid"
        words = bloom.words_for(ruled.count())
        some = bloom.flagged(docs.withColumn(rid, self._rid()), rid, bloom.of(ruled.select("rid"), "rid", words), words, f"{rid}f")
        straight = some.where(~F.col(f"{rid}f")).select(*docs.columns)
        met = some.where(f"{rid}f").drop(f"{rid}f").join(ruled.select(F.col("rid").alias(f"{rid}r"), F.col("stay").alias(f"{rid}s")), F.col(rid) == F.col(f"{rid}r"), "left")
        free = met.where(F.col(f"{rid}s").isNull()).select(*docs.columns)
        stay = met.where(f"{rid}s").dropDuplicates([rid]).select(*docs.columns)
        return straight.unionByName(free).unionByName(stay)

    def _rid(self) -> Column:
        """A hash of a row's id and text."""
        return F.xxhash64(F.col(self.id_col).cast("long"), F.lit(0), F.col(self.text_col))

    def _named(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """(rid, doc_id, size, node, root) of each row; root is null where nothing links."""
        spark, keep = docs.sparkSession, scratch.keep
        src = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), self._rid().alias("rid"), F.col(self.text_col).alias("text"))
        run, schema = _describe(self.shingle, self.percent)
        described = keep(src.mapInArrow(tidy(run), schema), "described")
        plan, upto, clash, reps = self._plan(described, scratch)
        if clash:
            other = F.expr(" OR ".join(f"(node = {k} AND twin <> {v})" for k, v in clash.items()))
            described = described.withColumn("node", F.when(other, _renamed(F.col("node"), F.col("twin"))).otherwise(F.col("node")))

        # One row stands for all with its set.
        words = bloom.words_for(reps.count())
        some = bloom.flagged(src.drop("doc_id"), "rid", bloom.of(reps, "rid", words), words, "maybe").where("maybe").select("text")
        run, schema = _publish(self.shingle, self.percent, upto, plan, clash)
        rows = some.mapInArrow(tidy(run), schema).select(F.explode("sigs").alias("sig"), "node", "size")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = rows.repartition(parts, "sig").sortWithinPartitions("sig", "node")
        met = keep(met.mapInArrow(tidy(_meet), "sig long, node long, size long, lead long"), "met")
        nodes = met.select("node").distinct()
        words = bloom.words_for(nodes.count())
        brief = bloom.flagged(described.where("size > 0"), "node", bloom.of(nodes, "node", words), words, "maybe").where("maybe")
        brief = keep(brief.groupBy("node").agg(F.min(F.struct("rid", "size", *SKETCH, "wide")).alias("b")).select("node", "b.*"), "brief")

        work = _Work(self, src.select("rid", "text"), brief, clash, scratch)
        stars = met.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        links = work.verified(work.close(stars), "links0")
        roots = connected(links, scratch, "c0_")
        # Buckets of two are done: one is the least.
        side = work.mixed(met.select("sig", "node", "lead", F.lit(CORE).cast("tinyint").alias("rank"), F.lit(0).cast("long").alias("over")), roots, 3, "mixed0")
        scratch.drop("met")
        pairs, turn = work.crossing(side, "pairs0", ["lead", "sig"]), 0
        while not (large := side.where("large")).isEmpty():
            turn += 1
            split = work.split(large, turn)
            links = links.union(split.where("linked AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
            roots = connected(links, scratch, f"c{turn}_")
            # The pivot has been compared with all.
            rows = split.where("node <> pivot").select("node", "lead", "over", F.explode(F.arrays_zip("keys", "marks")).alias("k"))
            side = work.mixed(rows.select(F.col("k.keys").alias("sig"), "node", "lead", F.col("k.marks").alias("rank"), "over"), roots, 2, f"mixed{turn}")
            pairs = pairs.union(work.crossing(side, f"pairs{turn}", ["sig"]))
        links = links.union(work.verified(work.apart(pairs.distinct(), roots), "links"))
        roots = connected(links, scratch, "c_")
        return described.select("rid", "doc_id", "size", "node").join(roots, "node", "left")

    def _plan(self, described: DataFrame, scratch: Scratch) -> tuple[Plans, int, dict[int, int], DataFrame]:
        """(segments by band as the measured meetings cost them, largest size, clashing nodes, a row hash for each set)."""
        reps = described.where("size > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.min("twin").alias("t0"), F.max("twin").alias("t1"), F.min("band").alias("band"), F.max("size").alias("size"), F.any_value("probes").alias("probes"))
        reps = scratch.keep(reps, "reps")
        # Of two in 2^64 sets, so that these are a handful at most.
        clash = {r["node"]: r["t0"] for r in reps.where("t0 <> t1").select("node", "t0").collect()}
        sets = {r["band"]: (r["n"], r["size"]) for r in reps.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()}
        met = reps.select("band", F.explode("probes").alias("p")).groupBy("band", "p").agg(F.count("*").alias("n"))
        met = met.groupBy("band", F.expr("p & 7").alias("r")).agg(F.sum(F.expr(f"n * least(n - 1.0D, {PAIRED})")).alias("met")).collect()
        by = {(x["band"], x["r"]): x["met"] for x in met}
        measured = {k: (float(n), tuple(by.get((k, r), 0.0) / n for r in range(1, PROBES + 1))) for k, (n, _) in sets.items()}
        upto = max((size for _, size in sets.values()), default=1)
        rids = reps.select("rid")
        if clash:
            rids = rids.union(described.where(F.col("node").isin(list(clash))).select("rid"))
        return plans(self.percent, upto, measured), upto, clash, rids


def _renamed(node: Column, twin: Column) -> Column:
    """What ``identities`` names a set of a clashing node."""
    name = F.udf(lambda n, t: int(W.mix(np.array([n], np.int64).view(np.uint64) ^ W.mix(np.array([t], np.int64).view(np.uint64), 15), 16).view(np.int64)[0]), "long")
    return name(node, twin)


class _Work:
    """The steps on pairs and buckets of one join, and the tables they share."""

    def __init__(self, join: NgramJaccardJoin, src: DataFrame, brief: DataFrame, clash: dict[int, int], scratch: Scratch):
        self.percent, self.shingle, self.src, self.brief, self.clash, self.scratch = join.percent, join.shingle, src, brief, clash, scratch

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches leave a link possible."""
        differ = " + ".join(f"bit_count(p.{k} ^ q.{k})" for k in SKETCH)
        most = f"p.size + q.size - 2 * ceil({self.percent} * (p.size + q.size) / {100 + self.percent}.0)"
        fine = f"100 * p.size >= {self.percent} * q.size AND 100 * q.size >= {self.percent} * p.size AND {differ} <= {most}"
        both = pairs.alias("e").join(self.brief.alias("p"), F.expr("e.a = p.node")).join(self.brief.alias("q"), F.expr("e.b = q.node"))
        return both.where(fine).select("e.a", "e.b")

    @staticmethod
    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        out = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        out = out.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def mixed(self, rows: DataFrame, roots: DataFrame, least: int, name: str) -> DataFrame:
        """Rows (sig, node, lead, root, rank, over, large) of the buckets of ``least`` rows or more that hold several components and pairs."""
        known = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = known.groupBy("sig").agg(*(F.count_if(F.col("rank") == r).alias(f"n{r}") for r in range(4)), F.min("root").alias("r0"), F.max("root").alias("r1"))
        several = several.where(f"r0 <> r1 AND n0 + n1 + n2 + n3 >= {least}")
        several = several.select("sig", "n0", "n1", F.expr("n0 * (n1 + n2 + n3) + n1 * (n1 - 1) / 2 + n1 * n2").alias("pairs"), F.expr(f"{PAIRED} * (n0 + n1 + IF(n1 > 0, n2, 0) + IF(n0 > 0, n2 + n3, 0))").alias("most"))
        out = known.join(several.where("pairs > 0"), "sig").where(f"rank <= {CORE} OR n0 > 0 OR (rank = {MIDDLE} AND n1 > 0)")
        return self.scratch.keep(out.select("sig", "node", "lead", "root", "rank", "over", F.expr("pairs > most").alias("large")), name)

    def crossing(self, side: DataFrame, name: str, dealt: list[str]) -> DataFrame:
        """Pairs of buckets that are not large, in different components, that sizes and sketches allow to link.

        Rows are dealt by the first of ``dealt``: a lead that is a bucket's least set is in no more buckets than it
        has signatures; the lead of a group that was split may be in most of them.
        """
        parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = side.where("not large").join(self.brief.select("node", "size", *SKETCH), "node")
        rows = rows.select("lead", "sig", "node", "size", "root", "rank", "over", *SKETCH).repartition(parts, dealt[0]).sortWithinPartitions(*dealt, "rank")
        return self.scratch.keep(rows.mapInArrow(tidy(_cross(self.percent)), "a long, b long"), name)

    def split(self, large: DataFrame, turn: int) -> DataFrame:
        """(node, lead, pivot, linked, keys, marks): members of large buckets, the pivots they were compared with, and the keys of their next buckets.

        A group is what meets one lead, the member that is in most large buckets; from the third turn on
        it is one bucket, whose members all share the shingle they met by: it goes into the centre, so that
        differences get shorter each time.
        """
        keep, name = self.scratch.keep, f"split{turn}"
        if turn < 3:
            weight = large.groupBy("node").agg(F.count("*").alias("w"))
            ranked = large.join(weight, "node").groupBy("sig").agg(F.max(F.struct("w", "node")).alias("p"))
            tries = large.select("sig", "node").join(ranked.select("sig", F.col("p.node").alias("lead")), "sig").select("node", "lead").distinct()
        else:
            tries = large.select("node", F.col("sig").alias("lead")).distinct()
        tries = keep(tries, f"{name}_tries")
        sets = self.sets(tries.select("node").distinct(), name)
        full = tries.join(sets, "node")
        some = tries.withColumn("k", F.expr("row_number() OVER (PARTITION BY lead ORDER BY xxhash64(node), node)")).where(F.col("k") <= VOTES)
        centres = some.join(sets, "node").groupBy("lead").agg(F.collect_list("items").alias("some")).mapInArrow(tidy(_majority), "lead long, centre binary")
        run, schema = _differ(self.percent)
        differ = keep(full.join(keep(centres, f"{name}_centres"), "lead").select("node", "lead", "items", "centre").mapInArrow(tidy(run), schema), f"{name}_differ")
        pivots = differ.groupBy("lead").agg(F.min(F.struct("over", "node", "size", "differ")).alias("p"))
        pivots = keep(pivots.select("lead", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.differ").alias("pivot_differ")), f"{name}_pivots")
        run, schema = _cut(self.percent)
        out = keep(differ.join(pivots, "lead").select("node", "lead", "size", "over", "differ", "pivot", "pivot_size", "pivot_differ").mapInArrow(tidy(run), schema), name)
        self.scratch.drop(*(f"{name}_{x}" for x in ("tries", "nodes", "sets", "centres", "differ", "pivots")))
        return out

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, items); reads again only the texts of the sets asked for."""
        keep = self.scratch.keep
        wanted = keep(nodes.join(self.brief.select("node", "rid"), "node"), f"{name}_nodes")
        words = bloom.words_for(wanted.count())
        some = bloom.flagged(self.src, "rid", bloom.of(wanted.select("rid"), "rid", words), words, "maybe").where("maybe")
        texts = some.select("rid", "text").join(wanted, "rid").select("node", "text")
        run, schema = _sets(self.shingle, self.clash)
        return keep(texts.mapInArrow(tidy(run), schema).dropDuplicates(["node"]), f"{name}_sets")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link: those that wide sketches leave possible, compared by their whole sets."""
        keep, brief = self.scratch.keep, self.brief
        wide = pairs.join(brief.select(F.col("node").alias("a"), F.col("size").alias("left_size"), F.col("wide").alias("left_wide")), "a")
        wide = wide.join(brief.select(F.col("node").alias("b"), F.col("size").alias("right_size"), F.col("wide").alias("right_wide")), "b")
        wide = wide.select("a", "b", "left_size", "right_size", "left_wide", "right_wide")
        near = keep(wide.mapInArrow(tidy(_possible(self.percent)), "a long, b long"), f"{name}_near")
        sets = self.sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), name)
        full = near.join(sets.select(F.col("node").alias("a"), F.col("items").alias("left_items")), "a")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right_items")), "b")
        out = keep(full.select("a", "b", "left_items", "right_items").mapInArrow(tidy(_verify(self.percent)), "a long, b long"), name)
        self.scratch.drop(f"{name}_near", f"{name}_nodes", f"{name}_sets")
        return out
