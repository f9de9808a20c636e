"""Secret scans: formats by pattern, and formats learnt from what the patterns find."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staging
from .text import over_texts, slices, strings

# The kinds in their order, and their patterns and least lengths.
KINDS = ("assign", "access", "hex")
LEARNT = "format"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
EDGES = ".=-"  # not part of a value at its ends
#: Texts without any of these hold no span of the patterns (RE2).
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: Values of a kind that teach its format, at least.
TEACHING = 20
_APART = r"[^A-Za-z0-9+/_.=-]+"


@dataclass(frozen=True)
class SecretConfig:
    """Bounds of what is learnt from: values of each kind, ordinary strings of either sort, the texts of those, and the length of any.

    Then merge strictness, the share of known values that a format may leave out, and by how much it must be likelier.
    """

    values: int = 400
    ordinary: int = 800
    texts: int = 2000
    length: int = 200
    alpha: float = 0.05
    quantile: float = 0.02
    margin: float = 0.5


Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end, value) of the patterns: leftmost, non-overlapping within a kind, too short ones dropped."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if re.search(r"[0-9a-f]{24}", text):
        found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span], accepted: dict[str, float]) -> list[tuple[int, int, str]]:
    """The accepted values among the runs of credential characters, but for those that a base span touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0].strip(EDGES)
        if value in accepted:
            start = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
            if not any(start < e and s < start + len(value) for _, s, e, _ in base):
                found.append((start, start + len(value), value))
    return found


def runs(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of credential characters, without their edges, of `least` characters or more, and the texts that they are of."""
    lists = pc.split_pattern_regex(texts, _APART)
    found, of = lists.flatten(), np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths(), dtype=np.int64))
    for trim in (lambda x: pc.ascii_trim(x, EDGES), lambda x: x):
        long = pc.greater_equal(pc.binary_length(found), max(1, least))
        found, of = trim(found.filter(long)), of[np.asarray(long)]
    return found, of


class Automaton:
    """A probabilistic automaton inferred from strings: a prefix tree whose statistically alike states are merged.

    States are merged in the order of the red-blue method: each state next to
    the accepted ones is merged with the first that it is compatible with, or
    accepted. Two states are compatible if the shares of strings that end
    there, and that go on with each character, differ no more than Hoeffding's
    bound at `alpha` allows, in all states that follow.
    """

    def __init__(self, words: list[str], alpha: float) -> None:
        self.ends, self.passes, self.next = [0], [0], [{}]
        for word in words:
            state = 0
            self.passes[0] += 1
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = [len(self.next), 0]
                    self.ends.append(0)
                    self.passes.append(0)
                    self.next.append({})
                edge = self.next[state][c]
                edge[1] += 1
                state = edge[0]
                self.passes[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._probabilities()

    def _alike(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.passes[a], self.passes[b]
            if not n or not m:
                continue
            most = self.bound * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            x, y = self.next[a], self.next[b]
            for c in x.keys() | y.keys():
                p, q = x.get(c), y.get(c)
                if abs((p[1] if p else 0) / n - (q[1] if q else 0) / m) > most:
                    return False
                if p and q:
                    stack.append((p[0], q[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state and those that follow it."""
        stack = [(into, tree)]
        while stack:
            into, tree = stack.pop()
            self.ends[into] += self.ends[tree]
            self.passes[into] += self.passes[tree]
            for c, (child, n) in self.next[tree].items():
                edge = self.next[into].get(c)
                if edge is None:
                    self.next[into][c] = [child, n]
                else:
                    edge[1] += n
                    stack.append((edge[0], child))

    def _infer(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda e: -self.next[e[0]][e[1]][1])
            parent, c = blue.pop(0)
            state = self.next[parent][c][0]
            if state in red:
                continue
            for r in red:
                if self._alike(r, state):
                    self.next[parent][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c][0] not in known]
        self.states = red

    def _probabilities(self) -> None:
        self.log: dict[int, dict[str, tuple[int, float]]] = {}
        self.stop, self.unseen = {}, {}
        for s in self.states:
            total = self.ends[s] + sum(n for _, n in self.next[s].values()) + 0.1 * (len(ALPHABET) + 1)
            self.log[s] = {c: (to, math.log((n + 0.1) / total)) for c, (to, n) in self.next[s].items()}
            self.stop[s] = math.log((self.ends[s] + 0.1) / total)
            self.unseen[s] = math.log(0.1 / total)

    def score(self, word: str) -> float:
        """Mean log-likelihood of a character of the string, its end included. Unseen characters stay in the state."""
        state, total = 0, 0.0
        for c in word:
            to, p = self.log[state].get(c, (state, self.unseen[state]))
            state, total = to, total + p
        return (total + self.stop[state]) / (len(word) + 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, log-likelihood) by state and character, and that of an end, with the first state as 0."""
        number = {s: i for i, s in enumerate(self.states)}
        to = np.repeat(np.arange(len(number))[:, None], len(ALPHABET), axis=1)
        log = np.repeat(np.array([self.unseen[s] for s in self.states])[:, None], len(ALPHABET), axis=1)
        for s, i in number.items():
            for c, (t, p) in self.log[s].items():
                if c in ALPHABET:
                    to[i, ALPHABET.index(c)], log[i, ALPHABET.index(c)] = number[t], p
        return to, log, np.array([self.stop[s] for s in self.states])


_CODE = np.zeros(256, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_FAR = 1000  # strings of more characters are scored one by one


def score_all(automata: list[Automaton], values: pa.Array) -> list[np.ndarray]:
    """The score by each automaton of all strings (of credential characters) at once, character by character."""
    length = np.asarray(pc.binary_length(values), dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    far = int((length > _FAR).sum())
    near, ends = order[far:], length[order[far:]]
    flat = _CODE[np.frombuffer(b"".join(values.take(pa.array(near)).cast(pa.large_binary()).to_pylist()), np.uint8)]
    starts = np.cumsum(ends) - ends
    out = []
    for automaton in automata:
        to, log, stop = automaton.tables()
        state, total = np.zeros(len(near), dtype=np.int64), np.zeros(len(near))
        for i in range(int(ends.max(initial=0))):
            active = int(np.searchsorted(-ends, -i, side="left"))  # those longer than i come first
            c = flat[starts[:active] + i]
            total[:active] += log[state[:active], c]
            state[:active] = to[state[:active], c]
        scores = np.empty(len(values))
        scores[near] = (total + stop[state]) / (ends + 1)
        for i in order[:far].tolist():
            scores[i] = automaton.score(values[i].as_py())
        out.append(scores)
    return out


@dataclass
class Formats:
    """Automata of the labelled kinds with the least score of each, and those of ordinary strings."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: list[Automaton]
    margin: float
    least: int = 1  # characters of the shortest value that taught a format

    def accepted(self, texts: pa.Array) -> tuple[dict[str, float], np.ndarray]:
        """The runs in these texts that a format accepts, with their scores, and whether each text has any; all of `least` characters or more are scored."""
        has = np.zeros(len(texts), dtype=bool)
        found, of = runs(texts, self.least) if self.kinds else (pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64))
        if not len(found):
            return {}, has
        coded = found.dictionary_encode()
        scores = score_all([*(a for a, _ in self.kinds.values()), *self.ordinary], coded.dictionary)
        own = np.max([np.where(s >= least, s, -np.inf) for s, (_, least) in zip(scores, self.kinds.values(), strict=False)], axis=0)
        above = own - np.max(scores[len(self.kinds) :], axis=0) - self.margin
        good = np.flatnonzero(above >= 0)
        has[of[np.isin(np.asarray(coded.indices), good)]] = True
        return dict(zip(coded.dictionary.take(pa.array(good)).to_pylist(), above[good].tolist(), strict=True)), has

    def score(self, text: str) -> float:
        """By how much a kind's format is likelier than an ordinary one, in log units a character; below 0: none accepts."""
        best = -math.inf
        for automaton, least in self.kinds.values():
            own = automaton.score(text)
            if own >= least:
                best = max(best, own)
        return best - max(o.score(text) for o in self.ordinary) - self.margin if best > -math.inf else -math.inf


def learn(values: dict[str, list[str]], words: list[str], others: list[str], config: SecretConfig) -> Formats:
    """Formats from labelled values, ordinary words and other candidates; a kind of fewer than TEACHING values is not learnt.

    Of the other candidates, numbers and those that no kind accepts are
    ordinary; what is left of them may be secrets and teaches nothing.
    """
    kinds = {}
    for kind, known in values.items():
        if len(known) >= TEACHING:
            automaton = Automaton(sorted(known), config.alpha)
            kinds[kind] = (automaton, float(np.quantile([automaton.score(v) for v in known], config.quantile)))
    least = min((len(v) for kind in kinds for v in values[kind]), default=1)
    numbers = [o for o in others if not any(c.isalpha() for c in o)] + [str(i * 7919 % 10**9).zfill(9) * 2 for i in range(1, 50)]
    strange = [o for o in others if any(c.isalpha() for c in o) and not any(a.score(o) >= least for a, least in kinds.values())]
    return Formats(kinds, [Automaton(sorted(part) or ["a"], config.alpha) for part in (words, numbers, strange)], config.margin, least)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))
_SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def labelled_values(rows: DataFrame) -> DataFrame:
    """(kind, value) of what the patterns find in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = strings(batch.column("text"))
                found = {(k, v) for t in texts.filter(pc.match_substring_regex(texts, _ANY)).to_pylist() for k, _, _, v in base_spans(t)}
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    return over_texts(rows.select("text"), run, "kind string, value string").distinct()


def ordinary_strings(rows: DataFrame, config: SecretConfig) -> list[str]:
    """Runs of credential characters, at most `length` long, outside of base spans, of the `texts` texts first by hash; at most `ordinary` words and as many others."""
    chosen = rows.select("th").distinct().orderBy("th").limit(config.texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in strings(batch.column("text")).to_pylist():
                at = 0
                for _, start, end, _ in [*base_spans(text), ("", len(text), len(text), "")]:
                    found |= {v.strip(EDGES) for v in CANDIDATE.findall(text[at:start])}
                    at = max(at, end)
            kept = sorted(v for v in found if 4 <= len(v) <= config.length)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["value"])

    some = over_texts(rows.join(F.broadcast(chosen), "th", "left_semi").dropDuplicates(["th"]).select("text"), run, "value string").distinct()
    word = F.col("value").rlike("^[A-Za-z]+$")
    return [r.value for part in (word, ~word) for r in some.where(part).orderBy(F.xxhash64("value"), "value").limit(config.ordinary).collect()]


def formats_of(rows: DataFrame, config: SecretConfig, staging: Staging) -> Formats:
    """Learns from at most config.values values of each kind and config.ordinary strings of either sort, those first by hash."""
    values = staging.write(labelled_values(rows), "values")
    known = {k: [r.value for r in values.where((F.col("kind") == k) & (F.length("value") <= config.length)).orderBy(F.xxhash64("value"), "value").limit(config.values).collect()] for k in KINDS}
    staging.drop("values")
    if not any(len(v) >= TEACHING for v in known.values()):
        return Formats({}, [], config.margin)
    plain = ordinary_strings(rows, config)
    return learn(known, [v for v in plain if v.isalpha()], [v for v in plain if not v.isalpha()], config)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SecretConfig | None = None, staging: Staging | None = None) -> DataFrame:
    """(doc_id, th, spans) for every row; spans are (kind, start, end, value, score) by start, then kind.

    Positions count code points, ends excluded. Spans of the three patterns
    always stay (score null). The values that they found are labelled
    credentials, of which each kind's format is inferred as a probabilistic
    automaton. All other runs of credential characters, from the length of the
    shortest value that taught a format on, are scored by format likelihood
    against ordinary strings, and those that a format accepts are spans of kind
    `format`. th is the hash of the text. Null texts are empty; repeated rows
    and null ids are scanned like others; very long texts and runs are scanned
    whole; where too few values are known to learn from, the patterns' spans
    are all; an empty table gives no rows; other columns are not read, whatever
    their names.
    """
    config = config or SecretConfig()
    staging = staging or Staging(docs.sparkSession, "secrets")
    rows = _rows(docs, id_col, text_col)
    formats = formats_of(rows, config, staging)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = strings(batch.column("text"))
                accepted, has = formats.accepted(texts)
                likely = has | np.asarray(pc.match_substring_regex(texts, _ANY))
                spans: list[list] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(likely).tolist():
                    text = texts[i].as_py()
                    base = base_spans(text)
                    found = [(*s, None) for s in base] + [(LEARNT, a, b, v, accepted[v]) for a, b, v in candidates(text, base, accepted)]
                    spans[i] = [dict(zip(_FOUND.value_type.names, s, strict=True)) for s in sorted(found, key=lambda s: (s[1], (*KINDS, LEARNT).index(s[0])))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(spans, _FOUND)], names=["doc_id", "th", "spans"])

    return staging.write(over_texts(rows, run, f"doc_id long, th long, spans {_SPANS}"), "found")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by a mark that names the first span's kind."""

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], kept, F.lit("[secret:"), span["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))
