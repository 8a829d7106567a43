"""Secret scan: every rule in one minimal byte automaton, one pass over the bytes of each whole text.

The combined automaton tells, byte by byte, which rules have a match ending there. Only at such a place do small anchored
automata of that rule walk back to the leftmost start and forward to the longest end, so that matches are those of a
leftmost, greedy, non-overlapping regular-expression search per rule. Work is linear in the text, whatever the rule count.

Cases: a null or empty text has no spans; repeated rows give equal results; very long texts are scanned whole; an empty
table gives an empty table; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.llm import automaton
from corvane.llm.common import map_text, remembered


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` followed by one or more bytes of the class ``body``; it counts if the body part has ``least`` bytes.

    A shorter match is dropped but still uses up its text. ``any_case`` is for the head. A ``block`` goes on behind the match with the
    lines of a key up to its closing line, or without one up to the last line that can belong to the key.
    """

    kind: str
    head: str
    body: str
    least: int
    any_case: bool = False
    block: bool = False


#: Lines of a key block: real line ends or those written as an escape; the last line may be short only before the closing one.
_LINE = rb"(?>(?:[ \t]*+(?:\r?\n|\\r|\\n))++[ \t]*+)"
_BLOCK = re.compile(rb"(?:" + _LINE + rb"(?:(?:Proc-Type|DEK-Info|Comment|Version)\x20*:[^\r\n\\]*|[A-Za-z0-9+/=]{16,}))*+"
                    rb"(?:(?:" + _LINE + rb"[A-Za-z0-9+/=]{1,15})?" + _LINE + rb"-----END\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?-----)?")

#: The rules of the contract, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
#: Published key formats that the base rules miss.
MORE_RULES = (
    Rule("forge", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("chat", r"xox[abeprs]\-", r"[A-Za-z0-9\-]", 24),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_.\-]", 60),
    Rule("pem", r"\-\-\-\-\-BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY", r"[\-]", 5, block=True),
)
RULES = BASE_RULES + MORE_RULES

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Scanner:
    """Compiled rules. ``spans(text bytes)`` gives (start, rule number, end) in bytes, sorted."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [automaton.parse(f"({r.head})", r.any_case) for r in rules]
        runs = [("rep", automaton.parse(r.body), 1, None) for r in rules]
        # without a head every byte of the class would be an end: such a rule reports only ends that are long enough,
        # which changes no match, since a run of the class is one match
        seen = [("cat", [h, ("rep", run[1], 1 if r.head else r.least, None)]) for r, h, run in zip(rules, whole, runs)]
        every = automaton.build(seen, anywhere=True)
        self.states, self.start = len(every.accepts), every.rows()[every.start]
        self.back = [automaton.build([automaton.reverse(("cat", [h, run]))], anywhere=False) for h, run in zip(whole, runs)]
        self.heads = [automaton.build([h], anywhere=False) for h in whole]
        self.bodies = [frozenset(automaton.parse(r.body)[1][0][1]) for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rules as bits) wherever some rule has a match that ends there: the one pass over all bytes.

        A state is the list of its successors, so a step is one list access.
        """
        marks = list(map(itemgetter(256), accumulate(data, getitem, initial=self.start)))
        return [(i, m) for i, m in enumerate(marks) if m] if any(marks) else []

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        out, used = [], [0] * len(self.rules)
        for end, bits in self.ends(data):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and end > used[k]:
                    start = self._leftmost(k, data, end, used[k])
                    if start is None:
                        continue
                    body = self._head_end(k, data, start)
                    stop = body
                    inside = self.bodies[k]
                    while stop < len(data) and data[stop] in inside:
                        stop += 1
                    if rule.block:
                        stop = _BLOCK.match(data, stop).end()
                    used[k] = stop
                    if stop - body >= rule.least:
                        out.append((start, k, stop))
        return sorted(out)

    def _leftmost(self, k: int, data: bytes, end: int, floor: int) -> int | None:
        """The smallest start, not before ``floor``, of a match of rule ``k`` that ends at ``end``."""
        dfa, s, best = self.back[k], self.back[k].start, None
        dead = _dead(dfa)
        for i in range(end - 1, floor - 1, -1):
            s = dfa.table[s, data[i]]
            if s == dead:
                break
            if s >= dfa.first_accept:
                best = i
        return best

    def _head_end(self, k: int, data: bytes, start: int) -> int:
        dfa, s, best = self.heads[k], self.heads[k].start, start
        dead = _dead(dfa)
        for i in range(start, len(data)):
            s = dfa.table[s, data[i]]
            if s == dead:
                break
            if s >= dfa.first_accept:
                best = i + 1
        return best


def _dead(dfa: automaton.Dfa) -> int:
    """The state that nothing leads out of, -1 if there is none."""
    stuck = np.flatnonzero((dfa.table == np.arange(len(dfa.table))[:, None]).all(axis=1) & (dfa.accepts == 0))
    return int(stuck[0]) if len(stuck) else -1


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per Python worker and rule set."""
    return remembered(f"secrets {rules}", lambda: Scanner(rules))


def _code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code-point offsets, counting each stretch once."""
    at, points, place = 0, 0, {}
    for cut in sorted({x for s, _, e in found for x in (s, e)}):
        points += len(data[at:cut].decode("utf-8", "replace"))
        at, place[cut] = cut, points
    return [(place[s], k, place[e]) for s, k, e in found]


def scan_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, result: str = "secret_spans", redact: bool = False,
                 mask: str = "[SECRET]") -> DataFrame:
    """Adds ``result``, an array of (kind, start, end) in code points, ordered by start, then rule. No shuffle.

    With ``redact`` the text column has each span (overlapping ones joined) replaced by ``mask``; a null text stays null.
    """
    kinds = [r.kind for r in rules]

    def run(texts: list) -> dict[str, list]:
        scan, spans, clean = scanner(rules), [], []
        for t in texts:
            data = (t or "").encode()
            found = scan.spans(data)
            spans.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in _code_points(data, found)])
            if redact:
                clean.append(t if not found else _masked(data, found, mask.encode()).decode())
        return {result: spans, **({text: clean} if redact else {})}

    fields = [(result, SPAN), *([(text, T.StringType())] if redact else [])]
    return map_text(df, run, fields, text, replace_text=redact)


def _masked(data: bytes, found: list[tuple[int, int, int]], mask: bytes) -> bytes:
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [data[at:s], mask]
        at = max(at, e)
    return b"".join([*out, data[at:]])


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
