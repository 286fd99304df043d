"""Many terms at once: an automaton over all terms of a glossary that passes over each text one time."""

from __future__ import annotations

import re
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term of these characters stands between other characters than ASCII letters and digits; any other stands anywhere.
SIMPLE = re.compile(r"[A-Za-z0-9_-]+")
#: In lower case, a term of these characters alone is found just where it is a whole word of a text.
WORD = re.compile(r"[a-z0-9]+")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Automata of glossaries that a task keeps while texts of their documents come.
KEPT = 64
#: Rows of a batch that are Python objects at once.
ROWS = 128


def folded(text: str) -> str:
    """text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


class Automaton:
    """The terms as a trie whose states know the longest suffix that is a state too (``fail``), and the next state on that way at which a term ends (``more``)."""

    def __init__(self, terms: Iterable[str | None], ignore_case: bool):
        self.fold = folded if ignore_case else str
        self.after: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int, bool]]] = [[]]
        for k, term in enumerate(terms):
            term = self.fold((term or "").strip())
            if not term:
                continue
            state = 0
            for c in term:
                state = self.after[state].setdefault(c, len(self.after))
                if state == len(self.after):
                    self.after.append({})
                    ends.append([])
            ends[state].append((k, len(term), SIMPLE.fullmatch(term) is not None))
        self.ends = [tuple(e) for e in ends]
        self.fail, self.more = [0] * len(ends), [0] * len(ends)
        waiting = deque(self.after[0].values())
        while waiting:
            state = waiting.popleft()
            for c, child in self.after[state].items():
                back = self.fail[state]
                while back and c not in self.after[back]:
                    back = self.fail[back]
                self.fail[child] = back = self.after[back].get(c, 0)
                self.more[child] = back if self.ends[back] else self.more[back]
                waiting.append(child)

    def used(self, text: str | None) -> set[int]:
        """The numbers of the terms that text has. Work grows with its length and the terms that end in it, not with the number of terms."""
        found: set[int] = set()
        if not text:
            return found
        text = self.fold(text)
        after, fail, ends, more = self.after, self.fail, self.ends, self.more
        state, last = 0, len(text) - 1
        for i, c in enumerate(text):
            to = after[state].get(c)
            while to is None and state:
                state = fail[state]
                to = after[state].get(c)
            state = to or 0
            hit = state if ends[state] else more[state]
            while hit:
                for k, n, simple in ends[hit]:
                    if k not in found and not (simple and (i >= n and text[i - n] in _PLAIN or i < last and text[i + 1] in _PLAIN)):
                        found.add(k)
                hit = more[hit]
        return found


def _mapped(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """The array of f of each row, made ROWS rows at a time: a batch's texts are never all Python objects."""
    parts = [pa.array([f(*row) for row in zip(*(c.slice(k, ROWS).to_pylist() for c in columns), strict=True)], kind) for k in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _automata() -> Callable[[tuple, bool], Automaton]:
    kept: OrderedDict[tuple, Automaton] = OrderedDict()

    def of(terms: tuple, ignore_case: bool) -> Automaton:
        if terms not in kept:
            kept[terms] = Automaton(terms, ignore_case)
            if len(kept) > KEPT:
                kept.popitem(last=False)
        kept.move_to_end(terms)
        return kept[terms]

    return of


def used_of_row(text: Column, terms: Column, ignore_case: bool = False) -> Column:
    """array<int>, ascending: the places in terms (an array of each row's own) of the terms that text has."""

    @F.arrow_udf("array<int>")
    def used(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = _automata()
        for texts, lists in batches:
            yield _mapped(lambda t, own: sorted(automaton(tuple(own or ()), ignore_case).used(t)), pa.list_(pa.int32()), texts, lists)

    return used(text, terms)


def used_of_all(text: Column, terms: list[str], order: list[int], most: int, ignore_case: bool = True) -> Column:
    """array<int>: of one list of terms for all texts, the places of the first ``most`` in ``order`` (lower is first) that text has."""

    @F.arrow_udf("array<int>")
    def used(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(terms, ignore_case)
        for texts in batches:
            yield _mapped(lambda t: sorted(automaton.used(t), key=order.__getitem__)[:most], pa.list_(pa.int32()), texts)

    return used(text)


def word_of(term: Column) -> Column:
    """The word that a text has just where it has a term, case ignored: the term in lower case, if it is of ASCII letters and digits; else null."""

    @F.arrow_udf("string")
    def word(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in batches:
            yield _mapped(lambda t: low if WORD.fullmatch(low := folded((t or "").strip())) else None, pa.string(), own)

    return word(term)


def words_of(text: Column) -> Column:
    """array<string>: the distinct words of a text, case ignored, among which word_of() a term is looked for."""

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _mapped(lambda t: list(set(WORD.findall(folded(t or "")))), pa.list_(pa.string()), texts)

    return words(text)
