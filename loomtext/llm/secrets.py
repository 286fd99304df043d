"""Secret scans: all rules in one automaton, one pass over the bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import _Parser, compile_rules, reverse
from .common import text_slices

# The base kinds as the task states them, in its order: name, pattern, either case, least length of
# the part that counts. Matches that are too short are dropped after matching, as they hide what lies inside
# them. Only hex has its length in the pattern: counters multiply the states, and a run's length hides nothing.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
)
#: Kinds that this method adds.
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
)
#: What stands before an assigned value.
_BEFORE_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""")


class Rules:
    def __init__(self, rules=BASE + MORE):
        self.names = [r[0] for r in rules]
        self.least = [r[3] for r in rules]
        trees = [_Parser(p, either).parse() for _, p, either, _ in rules]
        self.scan = compile_rules(trees, True)
        self.forward = [compile_rules([t], False) for t in trees]
        self.backward = [compile_rules([reverse(t)], False) for t in trees]

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """For each text the (rule, start, end) of its matches, in bytes of data, leftmost and longest, not overlapping within a rule."""
        ends, bits = self.scan.ends(data)
        raw = data.tobytes() if len(ends) else b""
        doc = np.searchsorted(offsets, ends, "left") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for r, name in enumerate(self.names):
            to = 0
            which = np.flatnonzero(bits & (1 << r))
            for e, d in zip(ends[which].tolist(), doc[which].tolist(), strict=True):
                if e <= to:
                    continue
                begin = max(to, int(offsets[d]))
                start = self.backward[r].longest(raw, e, begin, -1)
                if start < 0:  # its beginning lies in the match before
                    continue
                to = self.forward[r].longest(raw, start, int(offsets[d + 1]) - 1)
                counts_from = _BEFORE_VALUE.match(raw, start).end() if name == "assign" else start
                if to - counts_from < self.least[r]:
                    continue
                out[d].append((r, start, to))
        return out


_RULES: list[Rules] = []


def rules() -> Rules:
    """The compiled rules, made once in the driver."""
    if not _RULES:
        _RULES.append(Rules())
    return _RULES[0]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    spans joins kind:start:end with commas, by start, then in the order of the kinds; start and end count
    code points, end exclusive. base_sha256 is the hash of those of the base kinds joined alike.

    Null and empty texts have no spans. No shuffle; a text of any length is scanned whole; rows alike get
    rows alike; an empty table gives an empty result; other columns aren't read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(rules())  # bounded: it depends on the rules alone

    def run(batches):
        compiled = shared.value
        names = compiled.names
        for b in batches:
            out = []
            for _, data, offsets in text_slices(b.column(1), b"\xff"):
                for d, spans in enumerate(compiled.spans(data, offsets)):
                    a = int(offsets[d])
                    spans.sort(key=lambda s: (s[1], s[0]))
                    count = [sum(s[0] == k for s in spans) for k in range(len(BASE))]
                    if spans:
                        chars = np.concatenate([[0], np.cumsum((data[a : int(offsets[d + 1])] & 0xC0) != 0x80)])
                        spans = [(r, int(chars[s - a]), int(chars[e - a])) for r, s, e in spans]
                    text = [(r, f"{names[r]}:{s}:{e}") for r, s, e in spans]
                    base = ",".join(t for r, t in text if r < len(BASE))
                    out.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in text)))
            c = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
