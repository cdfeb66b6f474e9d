"""Secret scans: three base patterns, and formats learned by grammar inference.

Labelled credentials make a prefix tree for each format; compatible states are merged (ALERGIA, Carrasco and Oncina
1994) into a probabilistic automaton. Labelled are the strings that the base patterns find in the corpus, by kind, and
strings made by the rules of ``FORMATS``. Every token of a text with ``LEAST`` characters or more is a candidate, whatever
it is made of and whatever base span it lies in: its likelihood under the best automaton is held against that under a
background of character pairs, which are counted over all texts (without their long runs of letters and digits), and a token that a format explains better by
``MARGIN`` bits a character is a span of its own.

Null, empty and blank texts have no spans, an empty table gives an empty result; texts of any length are read whole and
repeated rows are scanned alike. Spans are code points, end exclusive, of whole pattern matches or whole candidates.
Columns other than doc_id and the text are not looked at, and redact keeps them as they are.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, strings

#: Labelled strings of the corpus that each automaton is fitted on at most, the longest of them (longer strings are scored,
#: not learned from), and strings made of each format.
MAX_TRAIN, MAX_LENGTH, MADE = 600, 512, 300
ALPHA = 0.05
#: Bits a character by which a format must beat the background.
MARGIN = 1.5
LEAST = 20

_upper, _lower, _digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Public credential formats as rules: parts of (fixed text, or alphabet and length), joined.
FORMATS: dict[str, list] = {
    "cloud access key": ["AKIA", (_upper + "234567", 16)],
    "code host token": ["ghp_", (_upper + _lower + _digit, 36)],
    "chat bot token": ["xoxb-", (_digit, 12), "-", (_digit, 12), "-", (_upper + _lower + _digit, 24)],
    "map service key": ["AIza", (_upper + _lower + _digit + "-_", 35)],
    "payment key": ["sk_live_", (_upper + _lower + _digit, 24)],
    "web token": ["eyJ", (_upper + _lower + _digit + "-_", 33), ".eyJ", (_upper + _lower + _digit + "-_", 60), ".", (_upper + _lower + _digit + "-_", 43)],
    "hex digest": [(_digit + "abcdef", 40)],
    "upper hex digest": [(_digit + "ABCDEF", 40)],
    "base64 secret": [(_upper + _lower + _digit + "+/", 40)],
}

# fixed patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched to be dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
KINDS = ("assign", "access", "hex", "format")
_words = ("pass", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches that are long enough."""
    out = []
    low = text.lower()
    if any(w in low for w in _words):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


@functools.cache
def _format_automata(n: int) -> list[Automaton]:
    return [Automaton(made(k, n)) for k in FORMATS]


def made(name: str, n: int) -> list[str]:
    """n labelled strings of a format, the same ones at every call."""
    rng = random.Random(name)
    return ["".join(x if isinstance(x, str) else "".join(rng.choices(x[0], k=x[1])) for x in FORMATS[name]) for _ in range(n)]


#: Characters of candidates; 0 in the background stands for all others and for a text's ends.
ALPHABET = _upper + _lower + _digit + "+/_.=-"
_place = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    _place[ord(_c)] = _i


class Automaton:
    """A probabilistic automaton over characters, learned by merging compatible states of a prefix tree."""

    #: Added to the count of each character and of the end.
    SMOOTH = 0.02

    def __init__(self, samples: list[str], alpha: float = ALPHA) -> None:
        self.ends: list[int] = [0]
        self.visits: list[int] = [len(samples)]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]  # of each edge
        for s in samples:
            at = 0
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self._learn(math.sqrt(0.5 * math.log(2 / alpha)))

    def _compatible(self, p: int, q: int, bound: float) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > most:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the states that its strings reach from p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, y in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def _learn(self, bound: float) -> None:
        """Red states are kept apart; a blue state, the next below them, is merged with the first compatible red one or turns red."""
        red, reds = [0], {0}
        while True:
            blue = min(((r, c) for r in red for c, y in self.next[r].items() if y not in reds), default=None)
            if blue is None:
                break
            parent, c = blue
            q = self.next[parent][c]
            for p in red:
                if self._compatible(p, q, bound):
                    self.next[parent][c] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
                reds.add(q)
        place = {r: i for i, r in enumerate(red)}
        wide = len(ALPHABET) + 1
        #: for each state: bits and next state by character, bits of any other character, bits of the end
        self.states = []
        for r in red:
            n = math.log2(self.visits[r] + self.SMOOTH * wide)
            steps = {c: (math.log2(k + self.SMOOTH) - n, place[self.next[r][c]]) for c, k in self.count[r].items()}
            self.states.append((steps, math.log2(self.SMOOTH) - n, math.log2(self.ends[r] + self.SMOOTH) - n))
        del self.ends, self.visits, self.next, self.count

    def bits(self, s: str) -> float:
        """log2 of the probability of the whole string, its end included; behind an edge that no sample took all characters are alike."""
        at, total = 0, 0.0
        for i, c in enumerate(s):
            steps, miss, _ = self.states[at]
            if c not in steps:
                return total + miss - (len(s) - i) * math.log2(len(ALPHABET) + 1)
            own, at = steps[c]
            total += own
        return total + self.states[at][2]


class Background:
    """Pairs of characters of all texts, 0 for whatever no candidate has; rare pairs lean on single characters. Or runs of one character."""

    LEAN, SAME = 2.0, 0.9

    def __init__(self, counts: np.ndarray) -> None:
        single = counts.sum(0) + 0.5
        single /= single.sum()
        self.logp = np.log2((counts + self.LEAN * single) / (counts.sum(1, keepdims=True) + self.LEAN))

    def bits(self, s: str) -> float:
        at = np.concatenate([[0], _place[np.frombuffer(s.encode("ascii"), np.uint8)], [0]])
        same = int((at[1:] == at[:-1]).sum())
        runs = same * math.log2(self.SAME) + (len(at) - 1 - same) * math.log2((1 - self.SAME) / len(ALPHABET))
        return max(float(self.logp[at[:-1], at[1:]].sum()), runs)


_OTHER = re.compile(rb"[^A-Za-z0-9+/_.=-]")


def _pairs(text: bytes, out: np.ndarray) -> None:
    """Add the text's character pairs to out; bytes above 127 count as other characters.

    So do runs of ``LEAST`` letters and digits or more: they are what is judged, and keys must not vouch for themselves.
    """
    i = 0
    while i < len(text):
        m = _OTHER.search(text, i + (1 << 20))  # pieces end between tokens
        to = m.start() if m else len(text)
        a = np.frombuffer(text[i:to], np.uint8)
        at = np.concatenate([[0], np.where(a < 128, _place[a & 127], 0), [0]])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ((at > 0) & (at <= 62)).astype(np.int8), [0]])))
        for x, y in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2)).ravel() >= LEAST]:
            at[x:y] = 0
        out += np.bincount(at[:-1] * out.shape[1] + at[1:], minlength=out.size).reshape(out.shape)
        i = to


def labelled(docs: DataFrame, text: str = "text", most: int = MAX_TRAIN) -> DataFrame:
    """Strings that the base patterns label with their kind, and the counts of character pairs (kind "pair", h the pair, n the count).

    A task keeps the ``most`` different strings with the least hashes for each label; those with the least of all are
    among them, whatever the partitions are. Pairs are counted over all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(set)
        pairs = np.zeros((len(ALPHABET) + 1, len(ALPHABET) + 1), np.int64)

        def keep(kind: str, s: str) -> None:
            if len(s) > MAX_LENGTH:
                return
            own = found[kind]
            own.add((xxhash.xxh64_intdigest(s.encode()) - (1 << 63), s))
            if len(own) > 8 * most:
                found[kind] = set(heapq.nsmallest(most, own))

        for batch in batches:
            for t in strings(batch, text):
                _pairs(t.encode("utf-8", "surrogatepass"), pairs)
                for a, k, b in base_spans(t):
                    keep(KINDS[k], ASSIGN.match(t, a)[2] if k == 0 else t[a:b])
        rows = [(k, *x, 0) for k, own in found.items() for x in heapq.nsmallest(most, own)]
        rows += [("pair", int(i), "", int(pairs.flat[i])) for i in np.flatnonzero(pairs)]
        yield pa.record_batch({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate({"kind": pa.string(), "h": pa.int64(), "s": pa.string(), "n": pa.int64()}.items())})

    return docs.select(text).mapInArrow(run, "kind string, h long, s string, n long")


def fit(docs: DataFrame, text: str = "text", most: int = MAX_TRAIN) -> dict:
    """An automaton for each kind, from at most ``most`` labelled strings taken by hash, and for each made format, and the background.

    The texts are read once; what their tasks keep is written, and its least strings and sums are taken from there.
    """
    rows = cut(labelled(docs, text, most), "labelled")
    samples = _least(rows.where("kind <> 'pair'").select("kind", "h", "s").distinct(), list(KINDS[:3]), most)
    counts = np.zeros((len(ALPHABET) + 1) ** 2)
    for r in rows.where("kind = 'pair'").groupBy("h").agg(F.sum("n").alias("n")).collect():
        counts[r["h"]] = r["n"]
    discard(rows)
    learned = [Automaton(samples[k]) for k in KINDS[:3] if len(samples[k]) >= 10]
    return {"automata": learned + _format_automata(MADE), "background": Background(counts.reshape(len(ALPHABET) + 1, -1))}


def _least(rows: DataFrame, kinds: list[str], most: int) -> dict[str, list[str]]:
    """The strings with the least hashes of each kind; one job, its result bounded by most * kinds."""
    out = {}
    parts = [rows.where(F.col("kind") == k).orderBy("h", "s").limit(most) for k in kinds]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    got = union.collect()
    for k in kinds:
        out[k] = sorted(r["s"] for r in got if r["kind"] == k)
    return out


def likelihood_gain(s: str, model: dict) -> float:
    """Bits a character by which the best format beats the background."""
    return (max(a.bits(s) for a in model["automata"]) - model["background"].bits(s)) / max(1, len(s))


def spans_of(text: str, model: dict | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by start, then kind as listed."""
    base = sorted(base_spans(text))
    extra = []
    if model and model["automata"]:
        extra = [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if likelihood_gain(m[0], model) > MARGIN]
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: dict | None = None, text: str = "text", model_from: DataFrame | None = None) -> DataFrame:
    """docs' doc_id with counts, digest and spans. The broadcast automata are bounded by MAX_TRAIN strings a kind."""
    model = model if model is not None else fit(model_from if model_from is not None else docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [spans_of(t, sent.value) for t in strings(batch, text)]
            n = [Counter(k for _, k, _ in base) for base, _ in got]
            yield pa.record_batch({
                "doc_id": batch.column(0),
                **{f"n_{KINDS[k]}": pa.array([x[k] for x in n], pa.int64()) for k in range(3)},
                "base_sha256": pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string()),
                "spans": pa.array([joined(every) for _, every in got], pa.string()),
            })

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of every text replaced by mark; overlapping spans become one mark. Null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, to = [], 0
        for a, _, b in spans_of(t, sent.value)[1]:
            if a >= to:
                out += [t[to:a], mark]
            to = max(to, b)
        return "".join([*out, t[to:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
