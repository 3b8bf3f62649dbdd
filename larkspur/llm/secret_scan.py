"""Secret scans: all rules compiled into one minimal deterministic automaton that reads every byte of a text once.

The automaton reads a text backwards and tells, at every byte, which rules have a match that starts there. A match then
runs forwards from the leftmost start through its own rule's automaton to its last accepted end.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.textvec import row_chunks


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression over bytes of sequences, classes, groups, alternatives and repeats.

    Matches are leftmost-longest, do not overlap others of their kind, and count only if they could have ended at ``least`` places.
    """

    kind: str
    pattern: bytes
    least: int = 1


#: The base rules. A run of 12 or 32 is asked for in the pattern where that finds the same as dropping shorter matches.
BASE = (
    Rule("assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8),
    Rule("access", rb"AKIA[A-Z0-9]{12,}"),
    Rule("hex", rb"[0-9a-f]{32,}"),
)
#: Rules added to the base: tokens with a public prefix, and headers of private keys.
ADDED = (
    Rule("prefixed", rb"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]+", 16),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 8),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Nfa:
    """Edges (from, set of bytes or None, to) of a rule, by Thompson's construction over the parsed expression."""

    def __init__(self, pattern: bytes):
        self.edges: list[tuple[int, frozenset[int] | None, int]] = []
        self.count = 0
        self.start, self.end = self.node(), self.node()
        self.sequence(_parser.parse(pattern), self.start, self.end, False)

    def node(self) -> int:
        self.count += 1
        return self.count - 1

    def sequence(self, items, start: int, end: int, either: bool) -> None:
        at = start
        for op, value in items:
            after = self.node()
            self.item(op, value, at, after, either)
            at = after
        self.edges.append((at, None, end))

    def item(self, op, value, start: int, end: int, either: bool) -> None:
        if op is _constants.LITERAL:
            self.edges.append((start, folded({value}, either), end))
        elif op is _constants.NOT_LITERAL:
            self.edges.append((start, frozenset(range(256)) - folded({value}, either), end))
        elif op is _constants.ANY:
            self.edges.append((start, frozenset(range(256)) - {10}, end))
        elif op is _constants.IN:
            chosen, negated = set(), False
            for kind, part in value:
                if kind is _constants.NEGATE:
                    negated = True
                elif kind is _constants.LITERAL:
                    chosen.add(part)
                elif kind is _constants.RANGE:
                    chosen.update(range(part[0], part[1] + 1))
                else:
                    raise ValueError(f"a class of a rule may not hold {kind}")
            chosen = folded(chosen, either)
            self.edges.append((start, frozenset(range(256)) - chosen if negated else chosen, end))
        elif op is _constants.SUBPATTERN:
            self.sequence(value[3], start, end, either or bool(value[1] & _constants.SRE_FLAG_IGNORECASE))
        elif op is _constants.BRANCH:
            for branch in value[1]:
                self.sequence(branch, start, end, either)
        elif op is _constants.MAX_REPEAT:
            low, high, body = value
            at = start
            for _ in range(low):
                after = self.node()
                self.sequence(body, at, after, either)
                at = after
            if high is _constants.MAXREPEAT:
                loop = self.node()
                self.edges.append((at, None, loop))
                self.sequence(body, loop, loop, either)
                self.edges.append((loop, None, end))
            else:
                for _ in range(high - low):
                    self.edges.append((at, None, end))
                    after = self.node()
                    self.sequence(body, at, after, either)
                    at = after
                self.edges.append((at, None, end))
        else:
            raise ValueError(f"a rule may not hold {op}")


def folded(chosen: set[int], either: bool) -> frozenset[int]:
    """With ``either``, letters stand for both cases."""
    return frozenset(chosen | {x ^ 32 for x in chosen if 65 <= x & ~32 <= 90} if either else chosen)


@dataclass
class Dfa:
    """A minimal automaton: ``classes`` maps a byte to its column, ``table`` (states x columns) to the next state; ``marks`` are bit sets of rules."""

    classes: np.ndarray
    table: np.ndarray
    marks: np.ndarray
    start: int

    def dead(self) -> int:
        """The state that nothing leaves and that marks nothing; -1 if there is none. A minimal automaton has one at most."""
        own = np.arange(len(self.table))[:, None]
        return next(iter(np.flatnonzero((self.table == own).all(1) & (self.marks == 0)).tolist()), -1)


def determinized(edges, starts: set[int], finals: dict[int, int], restart: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation by refining partitions; with ``restart`` a match may begin at every byte."""
    moves: dict[int, list[tuple[frozenset[int], int]]] = {}
    empty: dict[int, list[int]] = {}
    for a, chosen, b in edges:
        if chosen is None:
            empty.setdefault(a, []).append(b)
        else:
            moves.setdefault(a, []).append((chosen, b))
    kinds = sorted({chosen for _, chosen, _ in edges if chosen is not None}, key=sorted)
    signature = np.array([[byte in k for k in kinds] for byte in range(256)]).reshape(256, -1)
    _, sample, classes = np.unique(signature, axis=0, return_index=True, return_inverse=True)

    def closed(nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for b in empty.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    first = closed(starts)
    states, rows, todo = {first: 0}, [], [first]
    while todo:
        subset = todo.pop(0)
        row = []
        for byte in sample:
            into = closed({b for a in subset for chosen, b in moves.get(a, ()) if byte in chosen})
            into = into | first if restart else into
            if into not in states:
                states[into] = len(states)
                todo.append(into)
            row.append(states[into])
        rows.append(row)
    table = np.array(rows, np.int64)
    marks = np.array([sum({finals[n] for n in subset if n in finals}) for subset in states], np.int64)
    block = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    kept = np.unique(block, return_index=True)[1]
    return Dfa(classes.ravel().astype(np.uint8), block[table[kept]], marks[kept], int(block[0]))


@dataclass
class Scanner:
    """The compiled rules: one backward automaton of all of them, and a forward one for each."""

    rules: tuple[Rule, ...]
    backward: Dfa
    forward: list[Dfa]

    def __post_init__(self):
        # states that mark no start come first, so that one comparison a byte tells whether a match starts there
        order = np.argsort(self.backward.marks != 0, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        wide = self.backward.table.shape[1]
        self._next = (place[self.backward.table[order]] * wide).ravel().tolist()
        self._marks = self.backward.marks[order].tolist()
        self._wide, self._start = wide, int(place[self.backward.start]) * wide
        self._least = int((self.backward.marks == 0).sum()) * wide
        self._classes = self.backward.classes.tobytes()
        self._steps = [(d.classes.tobytes(), d.table.tolist(), d.marks.tolist(), d.start, d.dead()) for d in self.forward]

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches in bytes, by start, then rule."""
        table, least, state = self._next, self._least, self._start
        starts, at = [], len(data)
        for c in data.translate(self._classes)[::-1]:
            state = table[state + c]
            at -= 1
            if state >= least:
                starts.append((at, state))
        free, found = [0] * len(self.rules), []
        for at, state in reversed(starts):
            marks = self._marks[state // self._wide]
            for r, rule in enumerate(self.rules):
                if marks >> r & 1 and at >= free[r]:
                    classes, steps, accepts, s, dead = self._steps[r]
                    end = first = 0
                    for i in range(at, len(data)):
                        s = steps[s][classes[data[i]]]
                        if accepts[s]:
                            end, first = i + 1, first or i + 1
                        elif s == dead:
                            break
                    free[r] = end
                    if end - first + 1 >= rule.least:
                        found.append((at, r, end))
        return found


def compiled(rules: tuple[Rule, ...] = BASE + ADDED) -> Scanner:
    """Compiles rules; a rule that matches the empty text is refused."""
    edges, finals, starts, forward, shift = [], {}, set(), [], 0
    for r, rule in enumerate(rules):
        nfa = Nfa(rule.pattern)
        forward.append(determinized(nfa.edges, {nfa.start}, {nfa.end: 1}, False))
        if forward[-1].marks[forward[-1].start]:
            raise ValueError(f"{rule.kind} matches an empty text")
        edges += [(b + shift, chosen, a + shift) for a, chosen, b in nfa.edges]
        finals[nfa.start + shift] = 1 << r
        starts.add(nfa.end + shift)
        shift += nfa.count
    return Scanner(rules, determinized(edges, starts, finals, True), forward)


def code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """The code point index of byte places."""
    out, at, seen = {}, 0, 0
    for place in sorted(set(places)):
        seen += len(data[at:place].decode())
        at = place
        out[place] = seen
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans): the matches of all rules in documents (doc_id, text), array<struct<start, kind, end>> by start, then rule.

    Places are code points, ends exclusive. A null or empty text has no span, repeated rows have the same. The rules are
    compiled once on the driver and go to the tasks as arrays; texts are never shuffled, and each row stands alone.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(compiled(rules))
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def search(batches):
        find = scanner.value.find
        for batch in batches:
            for begin, stop in row_chunks(batch["text"]):
                out = []
                for text in batch["text"].slice(begin, stop - begin):
                    data = (text.as_py() or "").encode()
                    found = find(data)
                    at = code_points(data, [x for s, _, e in found for x in (s, e)]) if found else {}
                    out.append([{"start": at[s], "kind": rules[r].kind, "end": at[e]} for s, r, e in found])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, stop - begin).cast(pa.int64()), pa.array(out, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of documents: counts and hash of the base rules' spans, and all spans as text."""
    names = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return scan(docs).select("doc_id", *(count(k) for k in names), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
