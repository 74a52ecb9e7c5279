"""Secret scans by grammar inference.

Credentials that the base patterns label are put into a prefix tree for each
kind.  States whose next-symbol frequencies do not differ significantly (by
Hoeffding's bound) are merged, as in the ALERGIA algorithm, until a small
probabilistic automaton of the format is left.  Every long enough run of
credential characters in every text is then scored: its log-likelihood under
the best automaton against that of plain words, numbers and random characters.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import blocks, text_buffer
from .storage import small_batches

#: Fixed patterns and least lengths of the base kinds, in the order in which they are listed.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: Kind of the spans that the automata add.
FORMAT = "format"

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
END = len(SYMBOLS)
_CODE = np.full(256, 255, np.uint8)
_CODE[list(SYMBOLS.encode())] = np.arange(END)

#: Distinct labelled credentials of each kind that an automaton is fitted on, those with the least hash.
TRAIN = 400
#: Confidence of the merge test, and the added count of symbols that a state has not seen.
ALPHA, SMOOTH = 0.05, 0.01
#: Shortest candidate, and the least log-likelihood ratio (nats) of a finding.
MIN_LENGTH, THRESHOLD = 12, 8.0
#: Characters of runs at which a credential can start or end; others, such as a colon, end the run.
SEPARATORS = "=/.-"


def base_matches(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind number, kind, end, start of the value) of the base patterns, in order."""
    out = []
    for number, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), number, kind, m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _runs(inside: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` bytes, cut at the ends of texts."""
    edge = np.zeros(len(inside) + 1, np.int8)
    edge[:-1] = inside
    edge[1:] -= inside
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        starts, stops = np.sort(np.r_[starts, cuts]), np.sort(np.r_[stops, cuts])
    keep = stops - starts >= least
    return starts[keep], stops[keep]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEX, _UPPER, _SIGNS = _mask("0123456789abcdef"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), _mask(":=")


def suspects(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the texts that can hold a base match; all others are not looked at again."""
    places = [np.flatnonzero(_SIGNS[data]), _runs(_UPPER[data], ends, KINDS["access"][2])[0], _runs(_HEX[data], ends, KINDS["hex"][2])[0]]
    return np.unique(np.searchsorted(ends, np.concatenate(places), side="right") - 1)


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, value) of every base match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            kinds, values = [], []
            for i in suspects(*text_buffer(batch.column("text"))):
                text = batch.column("text")[int(i)].as_py()
                for _, _, kind, end, start in base_matches(text):
                    kinds.append(kind)
                    values.append(text[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string")


class Automaton:
    """A deterministic probabilistic automaton inferred from strings by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, smooth: float = SMOOTH):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        for s in strings:
            state = 0
            for c in s.encode("ascii"):
                symbol = int(_CODE[c])
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][symbol]
            self.count[state][END] = self.count[state].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._tables(smooth)

    def _compatible(self, a: int, b: int) -> bool:
        """The test of the two states and of all that is reached from both."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.count[a], self.count[b]
            n, m = sum(p.values()), sum(q.values())
            if not n or not m:
                continue
            limit = self.bound * (n**-0.5 + m**-0.5)
            if limit < 1 and any(abs(p.get(c, 0) / n - q.get(c, 0) / m) > limit for c in p.keys() | q.keys()):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _infer(self) -> None:
        """Red states are kept; each blue state, a child of a red one, is merged into a red state or becomes red."""
        red = [0]
        while True:
            blue = next(((r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in red), None)
            if blue is None:
                break
            r, c, t = blue
            for other in red:
                if self._compatible(other, t):
                    self.next[r][c] = other
                    self._fold(other, t)
                    break
            else:
                red.append(t)
        number = {s: i for i, s in enumerate(red)}
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in red]
        self.count = [self.count[s] for s in red]

    def _tables(self, smooth: float) -> None:
        """Transitions and log-probabilities; an unseen symbol keeps the state."""
        states = len(self.next)
        self.step = np.repeat(np.arange(states, dtype=np.int32)[:, None], END + 1, axis=1)
        counts = np.full((states, END + 1), smooth)
        for s in range(states):
            for c, t in self.next[s].items():
                self.step[s, c] = t
            for c, n in self.count[s].items():
                counts[s, c] += n
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


_LETTERS, _DIGITS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz."), _mask("0123456789.-")


def likelihood_ratios(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, automata: list[Automaton]) -> np.ndarray:
    """Best automaton against the best plain model, for runs of credential characters; one step for each character place, over all runs at once."""
    n = len(starts)
    if not n or not automata:
        return np.full(n, -np.inf)
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    begin, sizes = starts[order], length[order]
    states = [np.zeros(n, np.int32) for _ in automata]
    sums = [np.zeros(n) for _ in automata]
    letters, digits = np.ones(n, bool), np.ones(n, bool)
    for i in range(int(sizes[0]) + 1):
        live = int(np.searchsorted(-sizes, -i, side="right"))  # runs of at least i characters
        going = int(np.searchsorted(-sizes, -i, side="left"))  # and those that go on
        codes = np.full(live, END, np.uint8)
        codes[:going] = _CODE[data[begin[:going] + i]]
        letters[:going] &= _LETTERS[data[begin[:going] + i]]
        digits[:going] &= _DIGITS[data[begin[:going] + i]]
        for automaton, state, total in zip(automata, states, sums, strict=True):
            total[:live] += automaton.log[state[:live], codes]
            state[:live] = automaton.step[state[:live], codes]
    plain = -sizes * np.where(digits, math.log(12), np.where(letters, math.log(27), math.log(END)))
    out = np.empty(n)
    out[order] = np.max(sums, axis=0) - plain
    return out


def part_ratios(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, automata: list[Automaton], least: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best ratio of each run, and start, end and ratio of the best part for each end, where it is from ``threshold`` on.

    Parts start at the run's start or behind a separator, end before one or at the run's end and have
    ``least`` characters.  Of parts with equal ratios and one end the longest is the best.  Short runs are
    followed from all their starts at once, others by ``long_run``; the results are the same.
    """
    best = np.full(len(starts), -np.inf)
    none = np.zeros(0, np.int64)
    if not len(starts) or not automata:
        return best, none, none, np.zeros(0)
    sign = _mask(SEPARATORS)[data]
    inner = np.flatnonzero(sign[:-1] & ~sign[1:]) + 1
    run = np.searchsorted(starts, inner, side="right") - 1
    inside = (run >= 0) & (inner < stops[run])
    inner, run = inner[inside], run[inside]
    long = (stops - starts > LONG) | (np.bincount(run, minlength=len(starts)) > MANY)
    found = []
    for r in np.flatnonzero(long):
        a, b = int(starts[r]), int(stops[r])
        ends, begins, scores = long_run(data[a:b], np.r_[0, inner[run == r] - a], automata, least)
        best[r] = scores.max(initial=-np.inf)
        high = scores >= threshold
        found.append((begins[high] + a, ends[high] + a, scores[high]))
    begin, run = np.r_[starts[~long], inner[~long[run]]], np.r_[np.flatnonzero(~long), run[~long[run]]]
    size = stops[run] - begin
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= least]
    begin, run, size = begin[order], run[order], size[order]
    states, sums = [np.zeros(len(begin), np.int32) for _ in automata], [np.zeros(len(begin)) for _ in automata]
    letters, digits = np.ones(len(begin), bool), np.ones(len(begin), bool)
    for i in range(int(size[0]) + 1 if len(size) else 0):
        live = int(np.searchsorted(-size, -i, side="right"))  # starts with at least i characters behind them
        going = int(np.searchsorted(-size, -i, side="left"))  # and those that go on
        codes, at = data[begin[:going] + i], np.arange(going, live)
        if i >= least:
            at = np.r_[np.flatnonzero(sign[begin[:going] + i]), at]
            if len(at):
                score = np.max([total[at] + automaton.log[state[at], END] for automaton, state, total in zip(automata, states, sums, strict=True)], axis=0)
                score += i * np.where(digits[at], math.log(12), np.where(letters[at], math.log(27), math.log(END)))
                np.maximum.at(best, run[at], score)
                high = score >= threshold
                found.append((begin[at[high]], begin[at[high]] + i, score[high]))
        letters[:going] &= _LETTERS[codes]
        digits[:going] &= _DIGITS[codes]
        for automaton, state, total in zip(automata, states, sums, strict=True):
            total[:going] += automaton.log[state[:going], _CODE[codes]]
            state[:going] = automaton.step[state[:going], _CODE[codes]]
    if not found:
        return best, none, none, np.zeros(0)
    first, last, ratio = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, -ratio, last))
    order = order[np.r_[True, last[order][1:] != last[order][:-1]] if len(order) else order]
    return best, first[order], last[order], ratio[order]


#: Runs with more starts or characters are followed by ``long_run``; longest piece and most cells (piece x state) of its tables.
MANY, LONG, PIECE, CELLS = 32, 4096, 64, 1 << 20
#: Rows of ``long_run``: what a part is so far, and the plain model that it is compared with.  A part of letters is compared
#: with letters if it ends so and with random characters if other ones follow, so both sums are kept.
_MIXED, _LETTER, _LETTER_MIXED, _DIGIT, _DIGIT_MIXED, _DOT, _DOT_LETTER, _DOT_MIXED = range(8)
_PLAIN = np.log([END, 27, END, 12, END, 12, 27, END])
_ENDING = [_MIXED, _LETTER, _DIGIT, _DOT]


def long_run(data: np.ndarray, starts: np.ndarray, automata: list[Automaton], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, starts, ratios): the best part for each end of one run, in time that grows with its length.

    Parts that are in one state of an automaton go on alike, so only the best of them is followed: a number for each
    state and class of characters.  The run is cut where parts become long enough or end; what a piece
    adds from each state is worked out for many pieces at once.
    """
    codes, n = _CODE[data], len(data)
    offsets = np.cumsum([0] + [len(a.log) for a in automata])
    step = np.concatenate([a.step + o for a, o in zip(automata, offsets, strict=False)])
    log = np.concatenate([a.log for a in automata])
    count = len(log)
    starts = starts[starts + least <= n]
    ends = np.r_[np.flatnonzero(_mask(SEPARATORS)[data]), n]
    ends = ends[ends >= least]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # the first characters of each part
    state = np.repeat(offsets[None, :-1], len(starts), axis=0)
    total = np.zeros(state.shape)
    for i in range(least):
        c = codes[starts + i][:, None]
        total += log[state, c]
        state = step[state, c]
    strange = [np.r_[0, np.cumsum(~m[data])] for m in (_LETTERS, _DIGITS)]
    other, wordy = (x[starts + least] > x[starts] for x in strange)  # holds what is no letter; no digit
    cuts = np.unique(np.r_[starts + least, ends, np.arange(least, n, PIECE), n])
    entering = dict(zip((starts + least).tolist(), range(len(starts)), strict=True))
    is_end = np.isin(cuts, ends)
    value, origin = np.full((8, count), -np.inf), np.zeros((8, count), np.int64)
    ratios, begins = [], []
    chunk = max(1, CELLS // count)
    lines = np.arange(8)[:, None]
    for base in range(0, len(cuts), chunk):
        here = cuts[base : base + chunk]
        length = np.r_[cuts[base + 1 : base + chunk + 1], n][: len(here)] - here
        order = np.argsort(-length, kind="stable")
        target, gain = np.repeat(np.arange(count, dtype=np.int32)[None], len(here), axis=0), np.zeros((len(here), count))
        for i in range(int(length.max())):
            live = int(np.searchsorted(-length[order], -i, side="left"))
            c = codes[here[order[:live]] + i][:, None]
            gain[:live] += log[target[:live], c]
            target[:live] = step[target[:live], c]
        place = np.empty(len(here), np.int64)
        place[order] = np.arange(len(here))
        has_other, has_wordy = ((x[here + length] > x[here]).tolist() for x in strange)
        for k, at in enumerate(here.tolist()):
            j = entering.get(at)
            if j is not None:
                kind = (_MIXED,) if other[j] and wordy[j] else (_DIGIT, _DIGIT_MIXED) if other[j] else (_LETTER, _LETTER_MIXED) if wordy[j] else (_DOT, _DOT_LETTER, _DOT_MIXED)
                for r in kind:
                    new = total[j] + least * _PLAIN[r]
                    better = new > value[r, state[j]]
                    value[r, state[j][better]] = new[better]
                    origin[r, state[j][better]] = starts[j]
            if is_end[base + k]:
                final = value[_ENDING] + log[:, END]
                top = int(final.argmax())
                ratios.append(final.flat[top])
                begins.append(origin[_ENDING[top // count], top % count])
            if not length[k]:
                continue
            value += gain[place[k]] + (_PLAIN * length[k])[:, None]
            if has_other[k] or has_wordy[k]:
                _leave(value, origin, has_other[k], has_wordy[k])
            rank = np.argsort(value, axis=1, kind="stable")  # the best comes last, and the last one stays
            to = target[place[k]][rank]
            moved, origins = np.full_like(value, -np.inf), np.zeros_like(origin)
            moved[lines, to] = value[lines, rank]
            origins[lines, to] = origin[lines, rank]
            value, origin = moved, origins
    return ends, np.array(begins, np.int64), np.array(ratios)


def _leave(value: np.ndarray, origin: np.ndarray, other: bool, wordy: bool) -> None:
    """Parts change their class behind a piece with a character that is no letter (``other``) or no digit (``wordy``)."""
    moves = [(_DOT_MIXED, _MIXED)] if other and wordy else [(_DOT, _DIGIT), (_DOT_MIXED, _DIGIT_MIXED)] if other else [(_DOT_LETTER, _LETTER), (_DOT_MIXED, _LETTER_MIXED)]
    gone = [_DOT, _DOT_LETTER, _DOT_MIXED]
    if other:
        moves.append((_LETTER_MIXED, _MIXED))
        gone += [_LETTER, _LETTER_MIXED]
    if wordy:
        moves.append((_DIGIT_MIXED, _MIXED))
        gone += [_DIGIT, _DIGIT_MIXED]
    kept = {r: (value[r].copy(), origin[r].copy()) for r, _ in moves}
    value[gone] = -np.inf
    for source, row in moves:
        new, start = kept[source]
        better = new > value[row]
        value[row, better], origin[row, better] = new[better], start[better]


def train(docs: DataFrame, limit: int = TRAIN) -> list[Automaton]:
    """One automaton for each base kind, from at most ``limit`` distinct labelled values of it."""
    values = labelled(docs).distinct()
    return [Automaton([r.value for r in rows]) for kind in KINDS if (rows := values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(limit).collect())]


def best_apart(found: list[tuple[float, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (ratio, start, end), best first and longer before shorter, that overlap neither ``taken`` nor a better one.

    Chosen spans are kept apart and in order, so each is compared with its two neighbours alone.
    """
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    begins = [a for a, _ in merged]
    # of what is left, spans that overlap each other form clusters, in which few stand
    out: list[tuple[int, int]] = []
    cluster: list[tuple[float, int, int]] = []
    reach = -1

    def settle() -> None:
        chosen: list[tuple[int, int]] = []
        for _, a, b in sorted(cluster, key=lambda x: (-x[0], x[1] - x[2], x[1])):
            at = bisect.bisect_left(chosen, (a, b))
            if (at == 0 or chosen[at - 1][1] <= a) and (at == len(chosen) or chosen[at][0] >= b):
                chosen.insert(at, (a, b))
        out.extend(chosen)

    for ratio, a, b in sorted(found, key=lambda x: x[1:]):
        at = bisect.bisect_left(begins, b)  # the last taken span that starts before the end
        if at and merged[at - 1][1] > a:
            continue
        if a >= reach:
            settle()
            cluster = []
        cluster.append((ratio, a, b))
        reach = max(reach, b)
    settle()
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, best_score double"


def scan_secrets(docs: DataFrame, automata: list[Automaton] | None = None, threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row for each row of ``docs``: base counts and digest, and all spans as text.

    Spans are ``kind:start:end`` in code points, end exclusive.  Of the parts of a run with one end the best is
    a candidate; of candidates that overlap each other the best is listed, and none that overlaps a base match.  Null texts are empty and have no spans; without labelled credentials nothing
    but the base is found.  ``best_score`` is the highest ratio of the text's candidates, null if none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if automata is None else automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in blocks(batches):
            data, ends = text_buffer(batch.column("text"))
            rows = batch.num_rows
            starts, stops = _runs(_CODE[data] != 255, ends, min_length)
            scores, first, last, ratios = part_ratios(data, starts, stops, models, min_length, threshold)
            owner = np.searchsorted(ends, starts, side="right") - 1
            best = np.full(rows, -np.inf)
            np.maximum.at(best, owner, scores)
            leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte of the block
            found: dict[int, list[tuple[float, int, int]]] = {}
            text_of_span = np.searchsorted(ends, first, side="right") - 1
            begin = leads[first] - leads[ends[text_of_span]]
            for i, ratio, a, b in zip(text_of_span.tolist(), ratios.tolist(), begin.tolist(), (begin + last - first).tolist(), strict=True):
                found.setdefault(i, []).append((ratio, a, b))  # runs are ASCII: as many code points as bytes
            base: list[list] = [[] for _ in range(rows)]
            spans: list[list] = [[] for _ in range(rows)]
            added = [0] * rows
            for i in sorted(set(suspects(data, ends).tolist()) | found.keys()):
                text = batch.column("text")[i].as_py()
                base[i] = [(a, k, kind, b) for a, k, kind, b, _ in base_matches(text)]
                extra = [(a, len(KINDS), FORMAT, b) for a, b in best_apart(found.get(i, []), [(a, b) for a, _, _, b in base[i]])]
                added[i] = len(extra)
                spans[i] = sorted(base[i] + extra)
            text_of = lambda x: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in x)
            counts = [pa.array([sum(x[2] == kind for x in b) for b in base], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *counts,
                    pa.array([hashlib.sha256(text_of(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([text_of(s) for s in spans], pa.string()),
                    pa.array(added, pa.int64()),
                    pa.array([None if x == -np.inf else float(x) for x in best], pa.float64()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
