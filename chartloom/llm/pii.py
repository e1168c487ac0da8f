"""Personal data by fixed formats and by bootstrapped contextual extraction.

Four formats (e-mail, IPv4, card, phone) are found as stated in ``base_spans``.
Their matches are seed entities.  The words about an entity form two lexical
patterns: the two words before it, and the word before with the word after.  Tokens with three digits or more
that stand in the same places are candidate instances.  Spark scores the graph of patterns and
instances in rounds.  A pattern takes part once ``support`` different instances of it are accepted, seeds
or discovered ones, so that what one pattern discovers induces others; it
is as good as the mean of its instances, weighed
by how often its words stand about anything else in the corpus.  An instance
is as good as its patterns together, and accepted from ``confidence`` on.  Accepted instances under good patterns are
added as spans of kind ``ident``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as W
from .scratch import Scratch, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at each later start too, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][^0-9\x20\x09-\x0D]{0,3}[0-9][^0-9\x20\x09-\x0D]{0,3}[0-9]")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SPACES = frozenset(" \t\n\v\f\r")
_NEXT = re.compile(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld: each holds one @, so only those are looked at."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four formats, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def before(text: str, start: int) -> str | None:
    """The two words before a place, joined by a space, or None where there are fewer."""
    reach = 100
    while True:
        left = [x for x in _BLANK.split(text[max(0, start - reach) : start]) if x]
        if len(left) > 2 or reach >= start:
            return " ".join(left[-2:]) if len(left) >= 2 else None
        reach *= 4


def after(text: str, end: int) -> str | None:
    """The word after the token that holds the character before ``end``, or None where there is none."""
    m = _NEXT.match(text, end)
    return m[1] if m else None


def _fingerprint(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def identifiers(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with three digits close to each other, less marks at their edges, that touch no span of ``taken``."""
    out, ends = [], 0
    spans = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in _NUMBER.finditer(text):
        if m.start() < ends:
            continue
        a, b = m.start(), m.end()
        while a > ends and text[a - 1] not in _SPACES:
            a -= 1
        while b < len(text) and text[b] not in _SPACES:
            b += 1
        ends = b
        while a < m.start() and text[a] in _EDGE:
            a += 1
        while b > m.end() and text[b - 1] in _EDGE:
            b -= 1
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            out.append((a, b))
    return out


def about(w: W.Words) -> np.ndarray:
    """Hashes of each word with the word after the next."""
    with np.errstate(over="ignore"):
        return W.mix(w.hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[2:], 71)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() << 36
    context = pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("place", pa.int64()), ("till", pa.int64()), ("seed", pa.bool_())])
    names = ["row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "contexts"]
    for batch in batches:
        rows, texts, owner, contexts = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, salt = text or "", salt + 1
            base = base_spans(text)
            found = joined(base)
            rows.append((salt, doc, *(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(found.encode()).hexdigest(), found))
            for seed, spans in ((True, [s[1:] for s in base]), (False, identifiers(text, base))):
                for a, b in spans:
                    words, follows = before(text, a), after(text, b)
                    if words is not None:
                        # Three words each: a pattern is the first two, or the second with the third.
                        texts.append(f"{words} {follows or '.'}")
                        owner.append((len(rows) - 1, follows is not None))
                        contexts.append((_fingerprint(text[a:b]), a, b, seed))
        first = second = np.zeros(0, np.int64)
        if texts:
            buf, offsets = W.flat(pa.array(texts))
            w = W.Words(buf, offsets, lower=True)
            first, second = w.windows(2)[0][w.first[:-1]].view(np.int64), about(w)[w.first[:-1]].view(np.int64)
        per: list[list] = [[] for _ in rows]
        for (o, full), k, l, (i, a, b, s) in zip(owner, first.tolist(), second.tolist(), contexts):
            for key in (k, l) if full else (k,):
                per[o].append({"pattern": key, "instance": i, "place": a, "till": b, "seed": s})
        kinds = [pa.int64()] * 6 + [pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(per, pa.list_(context))], names=names)


def _background(bits: np.ndarray):
    """Occurrences in all texts of the patterns that may be in the filter ``bits``."""
    n = np.uint64(len(bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, w in W.rows(batch, "text", lower=True):
                pairs, inside = w.windows(2)
                _, wide = w.windows(3)
                pairs = np.concatenate([pairs[inside], about(w)[wide]]) if len(wide) else pairs[inside]
                word = bits[(pairs & n).astype(np.int64)]
                mask = (np.uint64(1) << ((pairs >> np.uint64(32)) & np.uint64(63))) | (np.uint64(1) << ((pairs >> np.uint64(44)) & np.uint64(63)))
                found.append(pairs[(word & mask) == mask])
            key, count = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["pattern", "n"])

    return run


class PiiFinder:
    """Finds personal data in every whole text; a null text is empty.

    Ids may be null or repeat: each row is a text.  Other columns are ignored;
    an empty table gives an empty result.  A pattern needs ``support`` different
    accepted instances; ``confidence`` is the score from which patterns and instances count.
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", support: int = 3, confidence: float = 0.6, rounds: int = 4):
        self.id_col, self.text_col, self.support, self.confidence, self.rounds = id_col, text_col, support, confidence, rounds

    def find(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of ``docs``."""
        spark = docs.sparkSession
        scratch = Scratch(spark)
        src = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text_col).alias("text"))
        shape = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, contexts array<struct<pattern:long,instance:long,place:long,till:long,seed:boolean>>"
        rows = scratch.keep(src.mapInArrow(tidy(_extract), shape), "rows")
        added = self.added(src, rows.select("row", F.explode("contexts").alias("c")).select("row", "c.*"), scratch)
        spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "extra").alias("spans")
        extra = added.groupBy("row").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_set(F.struct("place", "till"))), lambda s: F.concat_ws(":", F.lit("ident"), s["place"], s["till"]))).alias("extra"))
        return rows.join(extra, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans)

    def added(self, src: DataFrame, contexts: DataFrame, scratch: Scratch) -> DataFrame:
        """(row, place, till) of the instances that good patterns discover."""
        pairs = contexts.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("k"))
        many = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("k").alias("held")).where(F.col("instances") >= self.support)
        many = scratch.keep(many, "many")
        edges = scratch.keep(pairs.join(many.select("pattern"), "pattern").select("pattern", "instance", "seed"), "edges")
        # At most 2**18 words: patterns past the filter's capacity are counted in vain, never missed.
        words = 1 << 18
        table = bloom.of(many, "pattern", words).collect()
        if not table:
            return contexts.where("false").select("row", "place", "till")
        bits = np.zeros(words, np.uint64)
        bits[[r["word"] for r in table]] = np.array([r["bits"] for r in table], np.int64).view(np.uint64)
        near = src.select("text").mapInArrow(tidy(_background(bits)), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        weight = many.join(near, "pattern", "left")
        weight = scratch.keep(weight.select("pattern", (F.col("held") / F.greatest("held", F.coalesce("n", "held"))).alias("exact")), "weight")
        score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("s"))
        for i in range(self.rounds):
            accepted = F.count_if(F.col("s") >= self.confidence)
            good = edges.join(score, "instance").groupBy("pattern").agg(F.avg("s").alias("mean"), accepted.alias("accepted")).where(F.col("accepted") >= self.support)
            good = scratch.keep(good.join(weight, "pattern").select("pattern", (F.col("mean") * F.col("exact")).alias("p")), f"patterns{i}")
            each = edges.join(good, "pattern").groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.sum(F.log(F.lit(1.0) - 0.99 * F.col("p"))).alias("miss"))
            score = scratch.keep(each.select("instance", F.greatest("seed", 1 - F.exp("miss")).alias("s")), f"instances{i}")
        fine = contexts.where("not seed").join(good.where(F.col("p") >= self.confidence).select("pattern"), "pattern")
        return fine.join(score.where(F.col("s") >= self.confidence).select("instance"), "instance").select("row", "place", "till").distinct()
