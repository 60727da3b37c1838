"""Operator 8: secret scans with formats learned by grammar inference.

Base patterns label credentials, and all of them are learned from. Per kind a prefix tree of some labelled
credentials (over character classes) is generalised by merging statistically compatible states into a
probabilistic automaton: first states of one depth, which keeps lengths and prefixes, then states of
different depths where enough credentials say so. Whatever it does not accept of the kind's credentials
gives the next automaton, and what is left in the end a chain of character classes; each has its chances
counted over all credentials that it describes, and together they are a mixture. Every further candidate
is scored by its whole likelihood under the mixtures against that under a model of the corpus's ordinary
runs of characters, and kept where that ratio is one of labelled credentials and not one of ordinary runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from math import inf, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, is_empty, narrow, pieces, utf8

KINDS = ("assign", "access", "hex", "format")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Labelled credentials in a prefix tree (those with the smallest hashes), and the longest of them; further and longer
#: ones are counted, and what no tree's automaton accepts is learned by the next tree or, after so many, by a chain.
LABELLED = 400
LONGEST = 512
TREES = 4
#: Confidence of all compatibility tests of a state together; credentials that must pass through both of two states
#: of one depth, or of different depths, for a test to have any power.
ALPHA = 0.05
THICK, LOOP = 10, 40
#: Share of labelled credentials below the threshold, and the largest chance of ordinary runs above it.
BELOW = 0.02
ABOVE = 0.001
#: Scores a worker keeps.
KEPT = 1 << 18
#: Width of the classes of scores in which a rank is looked for.
STEP = 0.25

_CLASSES = str.maketrans(
    {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}}
    | {chr(c): "l" for c in range(ord("g"), ord("z") + 1)}
    | {chr(c): "U" for c in range(ord("A"), ord("Z") + 1)}
)


def base_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start, then kind as listed."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@cache
def _runs(least: int) -> re.Pattern:
    """Whole runs of credential characters, of least ones at least."""
    return re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{least},}}")


def candidates(text: str | None, least: int) -> list[tuple[int, str]]:
    """Runs of credential characters of least characters or more, in order, the longer first.

    A run with dots comes whole, without the dots at its ends, and cut at the dots.
    """
    if not text:
        return []
    found = set()
    for m in _runs(least).finditer(text):
        run, at = m[0], m.start()
        found.add((at, run))
        if "." in run:
            found.add((at + len(run) - len(run.lstrip(".")), run.strip(".")))
            found |= {(at + x.start(), x[0]) for x in re.finditer(r"[^.]+", run)}
    return sorted((x for x in found if len(x[1]) >= least), key=lambda x: (x[0], -len(x[1])))


class Ordinary:
    """What ordinary runs look like: chances of a character class after another, ends included."""

    SYMBOLS = "dhlU+/_.=-"

    def __init__(self, samples: list[str], counts: np.ndarray | None = None):
        n = len(self.SYMBOLS) + 1
        seen = np.ones((n, n)) + (self.pairs(" ".join(samples)) if counts is None else counts)
        logs = np.log(seen / seen.sum(1, keepdims=True)).tolist()
        ends = [*self.SYMBOLS, ""]
        self.logs = {(a, b): logs[i][j] for i, a in enumerate(ends) for j, b in enumerate(ends)}

    @classmethod
    def pairs(cls, text: str) -> np.ndarray:
        """How often each class follows each in the runs of a text, ends included."""
        n = len(cls.SYMBOLS) + 1
        codes = _CODES[np.frombuffer(b" " + utf8(text) + b" ", np.uint8)]
        seen = np.bincount(codes[:-1] * n + codes[1:], minlength=n * n).reshape(n, n)
        seen[-1, -1] = 0
        return seen

    def score(self, run: str) -> float:
        word, total, before = run.translate(_CLASSES), 0.0, ""
        for symbol in word:
            total += self.logs[before, symbol]
            before = symbol
        return total + self.logs[before, ""]


#: The number of each byte's class; what is not in runs has the last one.
_CODES = np.array([(Ordinary.SYMBOLS.find(chr(b).translate(_CLASSES)) if b < 128 else -1) % (len(Ordinary.SYMBOLS) + 1) for b in range(256)])


class Automaton:
    """A probabilistic automaton by state merging over a prefix tree of samples.

    Depth by depth, the children of the states of one depth are merged where ends and next symbols agree
    within Hoeffding's bound, in them and in what follows; a state that few samples reach joins one that
    already has its symbols. Then a state merges with an earlier one of another depth if both are reached by
    LOOP samples and agree likewise, which makes loops.
    """

    def __init__(self, samples: list[str], ordinary: Ordinary | None = None):
        self.ends = [0]
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self._root = [0]
        self.ordinary = ordinary or Ordinary([])
        for sample in samples:
            self._add(sample.translate(_CLASSES))
        self._tests = max(1, len(samples))
        self._merge_levels()
        self._merge_loops()
        self._number()
        scores = sorted(self.score(s) for s in samples)
        # A run with this ratio comes up among ordinary ones with a chance of ABOVE at most (Markov's inequality).
        self.threshold = max(scores[int(BELOW * len(scores))], -log(ABOVE)) if scores else inf
        self.least = self._shortest()

    @classmethod
    def chain(cls, ordinary: Ordinary) -> Automaton:
        """The automaton whose states are the last character class; it accepts all runs, and must be counted."""
        out = cls([], ordinary)
        step = {c: (i + 1, 0) for i, c in enumerate(Ordinary.SYMBOLS)}
        out.next = [dict(step) for _ in range(len(step) + 1)]
        out.ends = [1] * len(out.next)
        return out

    def path(self, run: str) -> list[tuple[int, str]] | None:
        """The states and symbols that a run passes, with "" at its end; None where no path leads."""
        at, out = 0, []
        for symbol in run.translate(_CLASSES):
            out.append((at, symbol))
            at = self.next[at].get(symbol, (-1, 0))[0]
            if at < 0:
                return None
        return [*out, (at, "")]

    def accepts(self, run: str) -> bool:
        way = self.path(run)
        return way is not None and self.ends[way[-1][0]] > 0

    def count(self, seen: dict[tuple[int, str], int]) -> None:
        """Take these counts of states and symbols in the place of the samples'."""
        self.ends = [seen.get((q, ""), 0) for q in range(len(self.next))]
        self.next = [{c: (to, seen[q, c]) for c, (to, _) in step.items() if (q, c) in seen} for q, step in enumerate(self.next)]
        self.least = self._shortest()

    def _add(self, word: str) -> None:
        at = 0
        for symbol in word:
            to, n = self.next[at].get(symbol, (0, 0))
            if not n:
                to = len(self.next)
                self.next.append({})
                self.ends.append(0)
                self._root.append(to)
            self.next[at][symbol] = (to, n + 1)
            at = to
        self.ends[at] += 1

    def _find(self, q: int) -> int:
        while self._root[q] != q:
            self._root[q] = self._root[self._root[q]]
            q = self._root[q]
        return q

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.next[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        todo, done = [(a, b)], set()
        wide = sqrt(log(2 * self._tests / ALPHA) / 2)
        while todo:
            a, b = (self._find(q) for q in todo.pop())
            if a == b or (a, b) in done:
                continue
            done.add((a, b))
            na, nb = self._total(a), self._total(b)
            bound = wide * (1 / sqrt(na) + 1 / sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                ta, ka = self.next[a].get(symbol, (None, 0))
                tb, kb = self.next[b].get(symbol, (None, 0))
                if abs(ka / na - kb / nb) > bound:
                    return False
                if ta is not None and tb is not None:
                    todo.append((ta, tb))
        return True

    def _fold(self, into: int, other: int) -> None:
        todo = [(into, other)]
        while todo:
            a, b = (self._find(q) for q in todo.pop())
            if a == b:
                continue
            self._root[b] = a
            self.ends[a] += self.ends[b]
            for symbol, (tb, kb) in self.next[b].items():
                ta, ka = self.next[a].get(symbol, (tb, 0))
                self.next[a][symbol] = (ta, ka + kb)
                todo.append((ta, tb))

    def _covers(self, a: int, b: int) -> bool:
        return self.next[b].keys() <= self.next[a].keys() and (not self.ends[b] or self.ends[a] > 0)

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            below = {self._find(to) for q in level for to, _ in self.next[q].values()}
            level = []
            for q in sorted(below, key=lambda q: (-self._total(q), q)):
                thin = self._total(q) < THICK
                for other in level:
                    if (self._covers(other, q) if thin else True) and self._compatible(other, q):
                        self._fold(other, q)
                        break
                else:
                    level.append(q)

    def _merge_loops(self) -> None:
        red = [0]
        while True:
            reached = [self._find(to) for q in red for _, (to, _) in sorted(self.next[q].items())]
            blue = next((q for q in reached if q not in red), None)
            if blue is None:
                return
            thick = self._total(blue) >= LOOP
            for other in red:
                if thick and self._total(other) >= LOOP and self._covers(other, blue) and self._compatible(other, blue):
                    self._fold(other, blue)
                    red = list(dict.fromkeys(map(self._find, red)))
                    break
            else:
                red.append(blue)

    def _number(self) -> None:
        order, at = [0], 0
        while at < len(order):
            order += [t for t in dict.fromkeys(self._find(to) for to, _ in self.next[order[at]].values()) if t not in order]
            at += 1
        number = {q: i for i, q in enumerate(order)}
        found = [{s: (number[self._find(t)], n) for s, (t, n) in self.next[q].items()} for q in order]
        self.ends, self.next = [self.ends[q] for q in order], found
        self._root = list(range(len(order)))

    def _shortest(self) -> float:
        """The length of the shortest run with any likelihood: what is shorter is no candidate."""
        reached, length = {0}, 0
        seen = set()
        while reached - seen:
            if any(self.ends[q] for q in reached):
                return max(1, length)
            seen |= reached
            reached = {to for q in reached for to, _ in self.next[q].values()}
            length += 1
        return inf

    def score(self, run: str) -> float:
        """Log of the likelihood of the whole run, over that of it as an ordinary run; minus infinity where no path leads."""
        at, total = 0, 0.0
        for symbol in run.translate(_CLASSES):
            to, n = self.next[at].get(symbol, (0, 0))
            if not n:
                return -inf
            total += log(n / self._total(at))
            at = to
        if not self.ends[at]:
            return -inf
        return total + log(self.ends[at] / self._total(at)) - self.ordinary.score(run)


class Mixture:
    """What describes all labelled credentials of a kind: automata, each with the number of them that it stands for."""

    def __init__(self, parts: list[tuple[int, Automaton]]):
        total = sum(n for n, _ in parts)
        self.parts = [(log(n / total), automaton) for n, automaton in parts]
        self.threshold = inf
        self.least = min(automaton.least for _, automaton in parts)

    def score(self, run: str) -> float:
        """As an automaton's, by the part that explains the run best."""
        return max(share + automaton.score(run) for share, automaton in self.parts)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, h, n): labelled credentials, and under "" how often (n) classes follow each other (h) in all other runs."""
    seen = 0
    for batch in pieces(batches):
        found, rest = set(), []
        for text in column(batch, "text"):
            spans = base_spans(text)
            found |= {(kind, value) for kind, _, _, value in spans}
            rest.append(redacted(text or "", [(*x[:3], None) for x in spans], " "))
        seen = seen + Ordinary.pairs("\n".join(rest))
        yield _rows([(k, v, xxhash.xxh3_64_intdigest(v.encode()) >> 1, 1) for k, v in found], _VALUES)
    yield _rows([("", None, h, n) for h, n in enumerate(np.ravel(seen).tolist()) if n], _VALUES)


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)


_VALUES = pa.schema([("kind", pa.string()), ("value", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
_PASSED = pa.schema([*_VALUES, ("state", pa.int64()), ("symbol", pa.string())])


def _passed(trees: dict[str, Automaton]):
    """Credentials that their kind's automaton doesn't accept, as they are; of the others how often states and symbols are passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            left = []
            for kind, value, h in zip(*(column(batch, c) for c in ("kind", "value", "h")), strict=True):
                if kind in trees and trees[kind].accepts(value):
                    seen.update((kind, *step) for step in trees[kind].path(value))
                else:
                    left.append((kind, value, h, 1, None, None))
            yield _rows(left, _PASSED)
        yield _rows([(kind, None, None, n, state, symbol) for (kind, state, symbol), n in seen.items()], _PASSED)

    return run


def infer_formats(docs: DataFrame, labelled: int = LABELLED) -> dict[str, Mixture]:
    """A mixture of automata for each base kind, from all its distinct credentials and all other runs.

    A tree takes `labelled` credentials at a time, which bounds the driver's memory; every credential is counted in the
    first automaton that accepts it, or in the chain.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    values = narrow(docs, "text").mapInArrow(_labelled, "kind string, value string, h bigint, n bigint")
    values = scratch.save(values.groupBy("kind", "value", "h").agg(F.sum("n").alias("n")), "labelled")
    size = len(Ordinary.SYMBOLS) + 1
    counts = np.zeros(size * size, np.int64)
    for r in values.where("kind = ''").collect():
        counts[r.h] = r.n
    model = Ordinary([], counts.reshape(size, size))
    parts: dict[str, list[tuple[int, Automaton]]] = {}

    def counted(trees: dict[str, Automaton]) -> DataFrame:
        """Take trees as the next parts; what they leave."""
        passed = left.mapInArrow(_passed(trees), "kind string, value string, h bigint, n bigint, state bigint, symbol string")
        passed = scratch.save(passed, "passed")
        seen: dict[str, dict] = {kind: {} for kind in trees}
        for r in passed.where("value is null").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():
            seen[r.kind][r.state, r.symbol] = r.n
        for kind, tree in trees.items():
            tree.count(seen[kind])
            parts.setdefault(kind, []).append((sum(tree.ends), tree))
        return passed.where("value is not null").select("kind", "value", "h")

    left = values.where("kind <> ''").select("kind", "value", "h")
    for _ in range(TREES):
        short = left.where(F.length("value") <= LONGEST)
        trees = {}
        for kind in KINDS[:3]:
            some = short.where(F.col("kind") == kind).orderBy("h", "value").limit(labelled).collect()
            if some:
                trees[kind] = Automaton([r.value for r in some], model)
        if not trees:
            break
        left = counted(trees)
        if is_empty(left):
            break
    lengths = left.groupBy("kind").agg(F.min(F.length("value")).alias("least")).collect()
    if lengths:
        chains = {r.kind: Automaton.chain(model) for r in lengths}
        counted(chains)
        for r in lengths:
            chains[r.kind].least = r.least
    out = {kind: Mixture(some) for kind, some in sorted(parts.items(), key=lambda x: KINDS.index(x[0]))}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = column(batch, "kind")
            scores = [out[kind].score(value) for kind, value in zip(kinds, column(batch, "value"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(scores, pa.float64())], ["kind", "score"])

    scores = values.where("kind <> ''").select("kind", "value").mapInArrow(scored, "kind string, score double")
    scores = scratch.save(scores.withColumn("step", F.floor(F.col("score") / STEP)), "scores")
    steps = scores.groupBy("kind", "step").agg(F.count("*").alias("n")).collect()
    for kind, mixture in out.items():
        mine = sorted((r.step, r.n) for r in steps if r.kind == kind)
        rank = int(BELOW * sum(n for _, n in mine))
        for step, n in mine:
            if rank < n:
                break
            rank -= n
        there = scores.where((F.col("kind") == kind) & (F.col("step") == step)).orderBy("score").offset(rank).limit(1)
        # A run with this ratio comes up among ordinary ones with a chance of ABOVE at most (Markov's inequality).
        mixture.threshold = max(there.first().score, -log(ABOVE))
    scratch.drop(values, scores)
    return out


class _Best(dict):
    """By how much a run passes the threshold of the format that explains it best; emptied when it is full."""

    def __init__(self, formats: dict[str, Automaton | Mixture]):
        super().__init__()
        self.formats = formats

    def __missing__(self, run: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        best = max((f.score(run) - f.threshold for f in self.formats.values()), default=-inf)
        if len(run) <= LONGEST:
            self[run] = best
        return best


def secret_spans(text: str | None, formats: dict[str, Automaton | Mixture] | _Best) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text: base ones, and candidates not covered by one that a format explains."""
    best = formats if isinstance(formats, _Best) else _Best(formats)
    base = base_spans(text)
    spans: list[tuple[str, int, int, float | None]] = [(k, s, e, None) for k, s, e, _ in base]
    least = min((f.least for f in best.formats.values()), default=inf)
    done = 0
    for start, value in candidates(text, least) if least < inf else ():
        end = start + len(value)
        if start < done:
            continue
        above = best[value]
        if above >= 0 and not any(s <= start and end <= e for _, s, e, _ in base):
            spans.append(("format", start, end, above))
            done = end
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int, float | None]], mark: str = "[secret]") -> str:
    """The text with every covered stretch replaced by a mark."""
    out, at = [], 0
    for _, start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, formats: dict[str, Automaton | Mixture] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, spans array<struct<kind, start, end, score>>, redacted_text, *keep).

    Positions are code points, ends exclusive. The score, for inferred formats only, is how far the
    log-likelihood ratio of the whole candidate lies above the kind's threshold. A null text is empty and stays null
    in redacted_text; repeated rows are scanned each; other columns than those to keep are ignored.
    """
    model = infer_formats(docs) if formats is None else formats
    names = ["doc_id", "spans", "redacted_text", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(model)
        for batch in pieces(batches):
            texts = column(batch, "text")
            found = [secret_spans(t, best) for t in texts]
            spans = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in f] for f in found]
            clean = [redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            arrays = [batch.column(0), pa.array(spans, _SPANS), pa.array(clean, pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted_text string"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep or [])
    return narrow(docs, "doc_id", "text", *(keep or [])).mapInArrow(run, schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the operator's spans."""
    def names(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan_secrets(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(names(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
        names(F.col("spans")).alias("spans"),
    )
