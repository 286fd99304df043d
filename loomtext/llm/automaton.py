"""Byte automata: patterns to one minimal deterministic automaton, run over many texts in lockstep."""

from __future__ import annotations

import numpy as np


class _Parser:
    """A small pattern language: literals, \\xHH, \\d, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}. Bytes only."""

    def __init__(self, pattern: str, either_case: bool = False):
        self.p, self.i, self.either = pattern.encode(), 0, either_case

    def parse(self):
        out = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unbalanced pattern at {self.i}")
        return out

    def peek(self) -> int | None:
        return self.p[self.i] if self.i < len(self.p) else None

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == ord("|"):
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in (None, ord("|"), ord(")")):
            x = self.atom()
            while (c := self.peek()) is not None and c in b"?*+{":
                self.i += 1
                low, high = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}.get(c, (0, 0))
                if c == ord("{"):
                    end = self.p.index(b"}", self.i)
                    a, comma, z = self.p[self.i : end].partition(b",")
                    low, high, self.i = int(a), int(z) if z else (None if comma else int(a)), end + 1
                x = ("rep", x, low, high)
            parts.append(x)
        return ("seq", parts)

    def cased(self, members: set[int]) -> frozenset[int]:
        return frozenset(members | {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}) if self.either else frozenset(members)

    def escaped(self) -> set[int]:
        c = self.p[self.i]
        self.i += 1
        if c == ord("x"):
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        return set(b"0123456789") if c == ord("d") else {c}

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == ord("("):
            out = self.alternatives()
            self.i += 1
            return out
        if c == ord("["):
            members: set[int] = set()
            while self.p[self.i] != ord("]"):
                a = self.one()
                if self.p[self.i] == ord("-") and self.p[self.i + 1] != ord("]"):
                    self.i += 1
                    a = set(range(min(a), max(self.one()) + 1))
                members |= a
            self.i += 1
            return ("in", self.cased(members))
        if c == ord("\\"):
            return ("in", self.cased(self.escaped()))
        return ("in", self.cased({c}))

    def one(self) -> set[int]:
        c = self.p[self.i]
        self.i += 1
        return self.escaped() if c == ord("\\") else {c}


def reverse(tree):
    """The tree of the reversed texts."""
    kind = tree[0]
    if kind == "in":
        return tree
    if kind == "seq":
        return ("seq", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:])


class _States:
    """A nondeterministic automaton: edges by byte sets, and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, a: int) -> int:
        """Add tree behind state a; the state at its end."""
        kind = tree[0]
        if kind == "in":
            z = self.new()
            self.edges[a].append((tree[1], z))
            return z
        if kind == "seq":
            for x in tree[1]:
                a = self.add(x, a)
            return a
        if kind == "or":
            z = self.new()
            for x in tree[1]:
                b = self.new()
                self.empty[a].append(b)
                self.empty[self.add(x, b)].append(z)
            return z
        _, x, low, high = tree
        for _ in range(low):
            a = self.add(x, a)
        if high is None:
            loop, z = self.new(), self.new()
            self.empty[a] += [loop]
            self.empty[loop].append(z)
            self.empty[self.add(x, loop)].append(loop)
            return z
        z = self.new()
        self.empty[a].append(z)
        for _ in range(high - low):
            a = self.add(x, a)
            self.empty[a].append(z)
        return z

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def compile_rules(trees: list, anywhere: bool) -> "Machine":
    """One minimal automaton for all rules, by subset construction and minimisation.

    anywhere: a rule may begin at any byte, and state 0 is where none has begun; otherwise at the first.
    """
    nfa, accept, starts = _States(), {}, []
    for k, tree in enumerate(trees):
        a = nfa.new()
        starts.append(a)
        accept[nfa.add(tree, a)] = 1 << k
    # bytes that no set tells apart are one class
    sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    kinds: dict[tuple, int] = {}
    class_of = np.zeros(256, np.uint16)
    for b in range(256):
        class_of[b] = kinds.setdefault(tuple(b in s for s in sets), len(kinds))
    example = {c: b for b, c in reversed(list(enumerate(class_of.tolist())))}
    n = len(kinds)
    first = nfa.closed(starts)
    number, todo, rows = {first: 0}, [first], []
    for states in todo:  # grows: subset construction
        row = []
        for c in range(n):
            to = {t for s in states for members, t in nfa.edges[s] if example[c] in members}
            to = nfa.closed(to | set(starts)) if anywhere else nfa.closed(to)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    marks = [0] * len(todo)
    for k, states in enumerate(todo):
        for s in states:
            marks[k] |= accept.get(s, 0)
    # minimisation: split blocks by marks, then by the blocks that each class leads to
    table = np.array(rows, np.int64)
    block = np.unique(np.array(marks), return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = {int(block[0]): 0}
    for b in block.tolist():
        order.setdefault(b, len(order))
    block = np.array([order[b] for b in block.tolist()])
    size = len(order)
    nexts, out = np.zeros((size, n), np.int64), np.zeros(size, np.int64)
    nexts[block], out[block] = block[table], marks
    return Machine(nexts, out, class_of)


class Machine:
    """A minimal automaton: nexts[state, class], marks[state] (a bit for each rule that ends there), class_of[byte]; state 0 begins."""

    def __init__(self, nexts: np.ndarray, marks: np.ndarray, class_of: np.ndarray):
        self.classes = nexts.shape[1]
        self.nexts, self.marks, self.class_of = nexts, marks, class_of
        self.flat = (nexts * self.classes).astype(np.int32).ravel()  # states times classes, so that a step is one addition and one look-up
        self.dead = [bool(m == 0 and (row == k).all()) for k, (row, m) in enumerate(zip(nexts, marks, strict=True))]
        self.by_byte: list[list[int]] = []

    def ends(self, data: np.ndarray, width: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places behind which rules end, and their bits; the machine must be one that begins anywhere.

        The bytes are cut into rows of width that advance together, each as if it began at state 0. Rows
        whose real first state was another are then advanced again until they meet the states
        they had; a row that never does hands its last state on.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = -(-n // width)
        cls = np.full(k * width, self.class_of[255], np.int32)
        cls[:n] = self.class_of[data]
        cls = np.ascontiguousarray(cls.reshape(k, width).T)
        states = np.empty((width, k), np.int32)
        now = np.zeros(k, np.int32)
        flat = self.flat
        for t in range(width):
            now = flat[now + cls[t]]
            states[t] = now
        began = np.zeros(k, np.int32)
        while True:
            real = np.concatenate([[0], states[-1][:-1]]).astype(np.int32)
            rows = np.flatnonzero(real != began)
            if not len(rows):
                break
            began[rows] = real[rows]
            now = real[rows]
            for t in range(width):
                now = flat[now + cls[t][rows]]
                same = now == states[t][rows]
                states[t][rows] = now
                if same.any():
                    rows, now = rows[~same], now[~same]
                    if not len(rows):
                        break
        bits = self.marks[np.arange(len(self.marks))]
        hit = np.zeros(len(bits) * self.classes, bool)
        hit[np.flatnonzero(bits) * self.classes] = True
        t, row = np.nonzero(hit[states])
        place = row.astype(np.int64) * width + t
        order = np.argsort(place)
        order = order[place[order] < n]
        return place[order] + 1, bits[states[t[order], row[order]] // self.classes]

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int:
        """Where the longest text ends that begins at `at` and stays before stop, read forward or (step -1) backward; -1 if none."""
        self.by_byte = self.by_byte or [row[self.class_of].tolist() for row in self.nexts]
        state, best, rows, marks, dead = 0, -1, self.by_byte, self.marks, self.dead
        while at != stop:
            state = rows[state][data[at if step > 0 else at - 1]]
            at += step
            if marks[state]:
                best = at
            elif dead[state]:
                break
        return best
