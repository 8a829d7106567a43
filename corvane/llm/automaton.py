"""Byte automata from regular expressions: Thompson construction, subset construction, minimisation.

The accepted syntax is what secret rules need: literals, ``\\xNN`` and escaped punctuation, classes, groups, ``|`` and
the quantifiers ``? * + {m} {m,} {m,n}``. Everything works on bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Syntax tree: ("set", frozenset of bytes) | ("cat", [trees]) | ("alt", [trees]) | ("rep", tree, least, most or None)


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i:end].partition(",")
                self.i = end + 1
                least, most = int(low), int(high) if high else (None if comma else int(low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
            tree = ("rep", tree, least, most)
        return tree

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2:self.i], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not supported")
        return ord(c)

    def letters(self, values) -> frozenset:
        values = set(values)
        if max(values, default=0) > 127:
            raise ValueError("patterns are ASCII")
        if self.any_case:
            values |= {ord(chr(v).swapcase()) for v in values if chr(v).isalpha()}
        return frozenset(values)

    def atom(self):
        if self.peek() == "(":
            self.take()
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.take()
            return tree
        if self.peek() == "[":
            self.take()
            values: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    values |= set(range(low, self.byte() + 1))
                else:
                    values.add(low)
            self.take()
            return ("set", self.letters(values))
        return ("set", self.letters([self.byte()]))


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).parse()


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree behind ``start`` and returns the node it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.node()
            for branch in tree[1]:
                first = self.node()
                self.empty[start].append(first)
                self.empty[self.add(branch, first)].append(end)
            return end
        _, body, least, most = tree
        for _ in range(least):
            start = self.add(body, start)
        if most is None:
            loop, end = self.node(), self.node()
            self.empty[start] += [loop, end]
            self.empty[self.add(body, loop)] += [loop, end]
            return end
        end = self.node()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(body, start)
        self.empty[start].append(end)
        return end

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """Minimal automaton. ``table[state, byte]`` is the next state; ``accepts[state]`` has a bit for each pattern that ends
    there. States are numbered so that accepting ones come last, from ``first_accept`` on."""

    table: np.ndarray
    accepts: np.ndarray
    start: int
    first_accept: int

    def rows(self) -> list[list]:
        """A list per state: at each byte the next state's list, at 256 the patterns that end in this state."""
        lists = [[0] * 257 for _ in self.accepts]
        for row, to, accept in zip(lists, self.table.tolist(), self.accepts.tolist()):
            row[:256] = [lists[s] for s in to]
            row[256] = accept
        return lists


def _union(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def build(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton for all patterns; with ``anywhere`` a match may start at every byte."""
    nfa = _Nfa()
    root = nfa.node()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.node()
        nfa.empty[root].append(first)
        end = nfa.add(tree, first)
        final[end] = final.get(end, 0) | 1 << k
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))

    # bytes that no pattern tells apart share a column
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature: dict[tuple, int] = {}
    column = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    example = [int(np.flatnonzero(column == c)[0]) for c in range(len(signature))]

    # node sets are bit masks; what each node reaches by each column is worked out once
    reach = [sum(1 << m for m in nfa.closure([n])) for n in range(len(nfa.empty))]
    into = [[_union(reach[to] for s, to in moves if b in s) for b in example] for moves in nfa.moves]
    movers = sum(1 << n for n, moves in enumerate(nfa.moves) if moves)
    begin = reach[root]
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        state = todo.pop()
        row = []
        sources = [into[n] for n in _bits(state & movers)]
        for c in range(len(example)):
            to = _union(masks[c] for masks in sources)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append((number[state], row))
    moves = np.array([row for _, row in sorted(rows)])
    marks = np.zeros(len(number), np.int64)
    for state, k in number.items():
        for end, bits in final.items():
            if state >> end & 1:
                marks[k] |= bits

    # minimisation: refine blocks until no column separates two states of one block
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    keep = np.unique(block, return_index=True)[1]
    small, accepts = block[moves[keep]], marks[keep]
    order = np.argsort(accepts > 0, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Dfa(place[small[order]][:, column].astype(np.int32), accepts[order], int(place[block[0]]), int((accepts == 0).sum()))
