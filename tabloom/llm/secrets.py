"""Secrets by one combined automaton: all rules are compiled together and scanned in a single byte pass.

The combined automaton reads a text backwards and marks every byte at which a match of some rule begins, so the leftmost
match is known without a second search; an anchored automaton of the one rule then finds its longest end.  A byte after
which the automaton is in its start state whatever came before cuts a text into stretches that are scanned side by side.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tabloom.llm.automaton import Dfa, compile_rules
from tabloom.llm.batches import append, as_bytes

STRETCH = 256


class Rule(NamedTuple):
    """Leftmost-longest, non-overlapping matches of ``pattern``; those that ``strict``, if given, does not match as a whole are dropped afterwards."""

    kind: str
    pattern: str
    strict: str | None = None


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"
_TOKEN = r"[A-Za-z0-9_-]"
#: Least lengths are left to the strict patterns, as counters multiply in a combined automaton.  Only the run of hex digits, which
#: would begin at every such letter of a text, has its own in the pattern; as a run ends where its digits do, that is the same.
BASE = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}"),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", rf"eyJ{_TOKEN}+\.eyJ{_TOKEN}+\.{_TOKEN}+", rf"eyJ{_TOKEN}{{8,}}\.eyJ{_TOKEN}{{8,}}\.{_TOKEN}{{8,}}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]+", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("login", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!$%&*+-]+@"),
)
RULES = BASE + ADDED
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Scanner(NamedTuple):
    starts: Dfa
    cuts: np.ndarray  # bytes that leave the automaton in its start state
    single: list[tuple[Dfa, Dfa | None]]
    kinds: list[str]


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    starts = compile_rules([r.pattern for r in rules], backwards=True, anywhere=True)
    single = [(compile_rules([r.pattern]), compile_rules([r.strict]) if r.strict else None) for r in rules]
    return Scanner(starts._replace(step=starts.step.astype(np.int32)), (starts.step == 0).all(axis=0), single, [r.kind for r in rules])


def marks(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which matches begin, ascending, with the rules as bits: one pass over ``data``, stretches side by side."""
    resets = np.flatnonzero(scan.cuts[data])
    resets = resets[np.unique(resets // STRETCH, return_index=True)[1]]
    bounds = np.unique(np.concatenate([offsets, resets + 1]))
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    end, length = bounds[1:][order] - 1, length[order]
    step, accept = scan.starts.step.ravel(), scan.starts.accept
    state = np.zeros(len(end), np.int32)
    found_at, found = [], []
    running = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
    for t, n in enumerate(running):
        at = end[:n] - t
        state[:n] = now = step[(state[:n] << 8) + data[at]]
        hit = accept[now]
        if hit.any():
            which = np.flatnonzero(hit)
            found_at.append(at[which])
            found.append(hit[which])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, bits = np.concatenate(found_at), np.concatenate(found)
    order = np.argsort(at)
    return at[order], bits[order]


def byte_spans(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Per text with matches: (start, rule, end) in bytes of the text, ascending."""
    at, bits = marks(scan, data, offsets)
    text = np.searchsorted(offsets, at, "right") - 1
    out: dict[int, list] = {}
    for i in np.unique(text):
        own = slice(*np.searchsorted(text, [i, i + 1]))
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        spans = []
        for rule, (loose, strict) in enumerate(scan.single):
            cursor = 0
            for start in (at[own][bits[own] >> rule & 1 == 1] - offsets[i]).tolist():
                if start < cursor:
                    continue
                cursor = loose.longest(raw, start)
                if strict is None or strict.longest(raw, start) == cursor:
                    spans.append((start, rule, cursor))
        if spans:
            out[int(i)] = sorted(spans)
    return out


def in_code_points(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``spans``: kind, start and end (exclusive) in code points, by start, then in the order of ``rules``.

    A NULL or empty text has an empty list; an input column named ``spans`` gives way.  Every row is scanned for itself.
    """

    def find(part: pa.RecordBatch) -> list:
        scan, column = scanner(rules), part.column(text)
        data, offsets = as_bytes(column)
        found = byte_spans(scan, data, offsets)
        rows = [[] for _ in range(len(column))]
        for i, spans in found.items():
            rows[i] = [{"kind": scan.kinds[k], "start": a, "end": b} for a, k, b in in_code_points(data[offsets[i] : offsets[i + 1]], spans)]
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return append(docs, find, [T.StructField("spans", SPANS)], text, keep)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``; texts without secrets, and NULL, stay as they are."""
    columns = docs.columns

    def clean(part: pa.RecordBatch) -> list:
        scan, column = scanner(rules), part.column(text)
        data, offsets = as_bytes(column)
        found = byte_spans(scan, data, offsets)
        if not found:
            return [column]
        out = column.to_pylist()
        for i, spans in found.items():
            raw, pieces, cursor, reach = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0, -1
            for a, _, b in spans:
                if a >= reach:
                    pieces += [raw[cursor:a], mark.encode()]
                cursor = reach = max(reach, b)
            out[i] = b"".join([*pieces, raw[cursor:]]).decode()
        return [pa.array(out, pa.string())]

    return append(docs, clean, [T.StructField(text, T.StringType())], text).select(*(f"`{c}`" for c in columns))
