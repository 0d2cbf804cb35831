"""Rule regexes compiled to minimal byte automata: positions, subset construction, partition refinement."""

from __future__ import annotations

from re import _constants as C, _parser
from typing import NamedTuple

import numpy as np


class Dfa(NamedTuple):
    """``step[state, byte]`` is the next state, ``accept[state]`` a bit set of rules; state 0 is the start."""

    step: np.ndarray
    accept: np.ndarray

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1; for anchored automata, whose state 1 can't accept any more."""
        step, accept, state, end = self.step, self.accept, 0, -1
        for i in range(at, len(data)):
            state = step[state, data[i]]
            if state == 1:
                break
            if accept[state]:
                end = i + 1
        return end


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []  # (set of bytes as bits, target)
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def build(self, tree, start: int, flags: int, backwards: bool) -> int:
        """Adds ``tree`` after ``start``; returns the state behind it."""
        for op, arg in reversed(tree) if backwards else tree:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                end = self.state()
                self.moves[start].append((_byte_set(op, arg, flags), end))
            elif op is C.SUBPATTERN:
                _, more, less, inner = arg
                end = self.build(inner, start, (flags | more) & ~less, backwards)
            elif op is C.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.build(inner, first, flags, backwards)].append(end)
            elif op is C.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    start = self.build(inner, start, flags, backwards)
                end = self.state()
                if most is C.MAXREPEAT:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[first].append(end)
                    self.empty[self.build(inner, first, flags, backwards)].append(first)
                else:
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.build(inner, start, flags, backwards)
                        self.empty[start].append(end)
            else:
                raise ValueError(f"rules can't use {op}")
            start = end
        return start


def _byte_set(op, arg, flags: int) -> int:
    if op is C.ANY:
        return ~(1 << 10) & ((1 << 256) - 1)
    items, negate = ([(C.LITERAL, arg)], op is C.NOT_LITERAL) if op is not C.IN else (arg, False)
    found: set[int] = set()
    for kind, value in items:
        if kind is C.NEGATE:
            negate = True
        elif kind is C.LITERAL:
            found.add(value)
        elif kind is C.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"rules can't use {kind}")
    if max(found, default=0) > 127:
        raise ValueError("rules are ASCII; text outside of it is matched byte by byte")
    if flags & C.SRE_FLAG_IGNORECASE:
        found |= {ord(c) for b in list(found) for c in (chr(b).lower(), chr(b).upper())}
    bits = sum(1 << b for b in found)
    return ~bits & ((1 << 256) - 1) if negate else bits


def compile_rules(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Dfa:
    """One minimal automaton for all ``patterns``.

    ``backwards`` reads the text from its end; ``anywhere`` lets a match begin at every byte.
    """
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for i, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        end = nfa.build(_parser.parse(pattern), first, 0, backwards)
        final[end] = final.get(end, 0) | 1 << i

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in final)

    signature = [tuple(k for k, (bits, _) in enumerate(m for x in nfa.moves for m in x) if bits >> b & 1) for b in range(256)]
    classes = {c: i for i, c in enumerate(dict.fromkeys(signature))}
    of_byte = np.array([classes[c] for c in signature])
    sample = [int(np.flatnonzero(of_byte == i)[0]) for i in range(len(classes))]
    start = closure([root])
    ids, rows = {start: 0, frozenset(): 1}, [[0] * len(classes), [1] * len(classes)]
    todo = [start] + ([frozenset()] if anywhere else [])
    while todo:
        now = todo.pop()
        for c, b in enumerate(sample):
            targets = {t for s in now for bits, t in nfa.moves[s] if bits >> b & 1}
            then = closure(targets) | start if anywhere else closure(targets)
            if then not in ids:
                ids[then] = len(rows)
                rows.append([0] * len(classes))
                todo.append(then)
            rows[ids[now]][c] = ids[then]
    accept = np.array([sum({final[s] for s in states if s in final}) for states in ids], np.int64)
    step, accept = _minimal(np.array(rows), accept)
    return Dfa(step[:, of_byte], accept)


def _minimal(step: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no text tells apart become one; state 0 stays the start, and state 1 the dead one if there is one."""
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys([block[0], block[1], *block.tolist()]))
    number = np.empty(block.max() + 1, np.int64)
    number[order] = np.arange(len(order))
    one = np.array([int(np.flatnonzero(block == b)[0]) for b in order])
    return number[block[step[one]]], accept[one]
