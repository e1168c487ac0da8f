"""Secrets by fixed formats and by automata inferred from labelled credentials.

Three formats (assignments, access keys, hex runs) are found as stated in
``base_spans``; their values are credentials labelled with the format's name.
For each label a bounded sample of values makes a prefix tree of
character classes with counts; states whose continuations do not differ
significantly (Hoeffding's bound, as in ALERGIA) are merged into a probabilistic
automaton.  Every other token of twelve credential characters or more is scored by
how much likelier an automaton makes it than ordinary text does (words, words in
capitals, numbers and rules), and added as kind ``format`` where the mean log
ratio a character is high.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, tidy

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs of 16 and more are the matches of [0-9a-f]+ that count.
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the three formats, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def classes(value: str) -> str:
    """Character classes: digits, a-f, other lower case, A-F, other upper case; a mark is its own class."""
    return value.translate(_CLASS)


_CLASS = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}})
_WIDTH = {"9": 10, "a": 6, "g": 20, "A": 6, "G": 20}
END = "$"
PREFIX = 200
"""Characters of a value that an automaton learns from; of a longer one it does not learn where it ends."""


class Automaton:
    """A probabilistic automaton merged from a prefix tree of strings."""

    def __init__(self, strings: list[str], alpha: float = 0.05, least: int = 8):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            for c in s[:PREFIX]:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            if len(s) <= PREFIX:
                self.count[at][END] = self.count[at].get(END, 0) + 1
        self.bound, self.least = math.sqrt(0.5 * math.log(2 / alpha)), least
        self._merge()
        self.log = [{c: math.log((n.get(c, 0) + 0.01) / (sum(n.values()) + 0.2)) - math.log(_WIDTH.get(c, 1)) for c in [*to, END]} for n, to in zip(self.count, self.next)]

    def _alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = sum(self.count[p].values()), sum(self.count[q].values())
            if n < self.least or m < self.least:
                continue
            limit = self.bound * (n**-0.5 + m**-0.5)
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p].get(c, 0) / n - self.count[q].get(c, 0) / m) > limit:
                    return False
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the counts of the tree below a state to a state; the tree shares no states."""
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t

    def _merge(self) -> None:
        red, seen = [0], {0}
        blue = deque((0, c) for c in sorted(self.next[0]))
        while blue:
            p, c = blue.popleft()
            q = self.next[p][c]
            if q in seen:
                continue
            for r in red:
                if self._alike(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                seen.add(q)
            done = set(blue)
            for s in red:
                blue.extend((s, x) for x in sorted(self.next[s]) if self.next[s][x] not in seen and (s, x) not in done)
        self.states = len(red)

    def log_likelihood(self, s: str) -> float:
        """Of a class string, with the share of each character in its class."""
        at, total = 0, 0.0
        for c in s:
            if c not in self.next[at]:
                return -math.inf
            total += self.log[at][c]
            at = self.next[at][c]
        return total + self.log[at][END]


def train(samples: dict[str, list[str]]) -> dict[str, Automaton]:
    return {k: Automaton([classes(v) for v in values]) for k, values in samples.items() if len(values) >= 20}


_WORD = {"9": 0.002, "a": 0.26, "g": 0.68, "A": 0.012, "G": 0.03}
"""How often a character of ordinary prose is of a class; marks share the rest."""
_CAPITALS = {"9": 0.002, "a": 0.006, "g": 0.016, "A": 0.26, "G": 0.68}
_DIGITS = {"9": 0.84, "a": 0.006, "g": 0.016, "A": 0.006, "G": 0.016}
_RULE = {"9": 0.002, "a": 0.002, "g": 0.002, "A": 0.002, "G": 0.002}
_MARKS = frozenset("+/_=-")


def _logs(shares: dict[str, float], mark: float) -> dict[str, float]:
    return {c: math.log(shares[c] / w) for c, w in _WIDTH.items()} | {c: math.log(mark) for c in _MARKS}


_PLAIN = [(math.log(share), _logs(model, mark)) for share, model, mark in ((0.97, _WORD, 0.003), (0.01, _CAPITALS, 0.003), (0.01, _DIGITS, 0.02), (0.01, _RULE, 0.19))]
"""Ordinary text: words, words in capitals, numbers, rules of marks; how common each is, and what its characters are."""

_OTHER = math.log(0.003)


def ratio(value: str, automata: dict[str, Automaton]) -> float:
    """The best mean log ratio a character of an automaton over ordinary prose."""
    s = classes(value)
    plain = max(share + sum(logs.get(c, _OTHER) for c in s) for share, logs in _PLAIN)
    return max(((a.log_likelihood(s) - plain) / len(s) for a in automata.values()), default=-math.inf)


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens of 12 credential characters or more that touch no base span."""
    out, k = [], 0
    spans = sorted((s[1], s[2]) for s in taken)
    for m in _TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        v = m[0]
        if k == len(spans) or spans[k][0] >= m.end():
            out.append((m.start(), m.end(), v))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() << 36
    value = pa.struct([("kind", pa.string()), ("place", pa.int64()), ("till", pa.int64()), ("value", pa.string())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(value), pa.list_(value)]
    names = ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "known", "open"]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, salt = text or "", salt + 1
            base = base_spans(text)
            found = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base)
            known = [{"kind": k, "place": a, "till": b, "value": v[: PREFIX + 1]} for k, a, b, v in base]
            free = [{"kind": "format", "place": a, "till": b, "value": v} for a, b, v in candidates(text, base)]
            rows.append((salt, doc, *(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(found.encode()).hexdigest(), found, known, free))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, kinds)], names=names)


def _score(automata: dict[str, Automaton], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, free in zip(batch.column("base").to_pylist(), batch.column("open").to_pylist()):
                more = [(x["place"], 3, f"format:{x['place']}:{x['till']}") for x in free if ratio(x["value"], automata) >= least]
                if more:
                    old = [s.split(":") for s in base.split(",") if s]
                    both = sorted([(int(a), KINDS.index(k), f"{k}:{a}:{b}") for k, a, b in old] + more)
                    base = ",".join(s for *_, s in both)
                spans.append(base)
            columns = [batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


class SecretScanner:
    """Finds secrets in every whole text; a null text is empty.

    Ids may be null or repeat: each row is a text.  Other columns are ignored;
    an empty table gives an empty result.  Automata are learnt from at most
    ``sample`` different labelled values of each kind, those with the least
    hashes, 200 characters of each (a longer one teaches no end); a kind with fewer than 20 has none.
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", sample: int = 400, least_ratio: float = 0.4):
        self.id_col, self.text_col, self.sample, self.least_ratio = id_col, text_col, sample, least_ratio

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of ``docs``."""
        scratch = Scratch(docs.sparkSession)
        one = "array<struct<kind:string,place:long,till:long,value:string>>"
        shape = f"row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, known {one}, open {one}"
        rows = scratch.keep(docs.select(F.col(self.id_col).cast("long"), F.col(self.text_col)).mapInArrow(tidy(_extract), shape), "rows")
        values = rows.select(F.explode("known").alias("k")).select("k.kind", "k.value").distinct()
        samples: dict[str, list[str]] = {}
        for kind in KINDS:
            some = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(self.sample)
            samples[kind] = [r["value"] for r in some.collect()]
        automata = train(samples)
        return rows.mapInArrow(tidy(_score(automata, self.least_ratio)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
