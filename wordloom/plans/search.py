"""Search for the smallest program of one stream, within a budget of expansions.

Partial programs are taken in order of cost so far plus a bound on what is to come,
then of bytes at least, then of making. A full program replaces the best only if it is
smaller by bytes. The literal of the whole stream is the first best, so there is always
an exact answer.

What waits in the queue is choices and shapes, no words: the words of the hole that is
taken are made again from the stream, along its own ancestors. The words held at a time
are those of one branch, whatever the budget.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from wordloom.functions.dtypes import DTYPES, EngineError
from wordloom.operators.encodings import storage

from .grammar import Choice, Limits, build, child, children, choice_of, fixed_bytes, propose, shapes, storage_bytes
from .prior import ROOT, Prior, context, log_cost
from .program import Node, execute, lit, size, type_of

HEADER = 5


@dataclass(frozen=True)
class Config:
    expansions: int = 32
    nodes: int = 32
    limits: Limits = field(default_factory=Limits)
    heuristic: bool = True
    seed_float: bool = False
    open_bytes: int = 512 << 20


@dataclass
class Result:
    program: Node
    bytes: int
    status: str
    expanded: int
    completed: int


@dataclass(frozen=True)
class _Hole:
    n: int
    bits: int
    depth: int
    parent: int
    slot: int


class _Branch:
    """A stream by how it comes from the one above; its words are made when they are asked for."""

    def __init__(self, words, bits: int, above: _Branch | None = None, choice: Choice | None = None, i: int = 0):
        self._words, self.bits, self.above, self.choice, self.i = words, bits, above, choice, i

    def words(self) -> np.ndarray:
        if self._words is None:
            self._words = child(self.choice, self.above.words(), self.above.bits, self.i)
        return self._words

    def key(self) -> tuple:
        return (*self.above.key(), (self.choice, self.i)) if self.above else ()


def completion_costs(dtype: str, bounds_of, depth: int):
    """(bits, length, depth) -> a cost that every completion of a hole has at least.

    A hole is filled by a literal, a constant, or a production and its own holes; the
    number of families that compete is taken as small as it can be.
    """
    d = DTYPES[dtype]

    @lru_cache(None)
    def c(bits: int, many: bool, at: int) -> int:
        capped = at >= depth
        n = (2 if many or capped else 1) if capped else 2 if bits == 1 else 6 if many else 5
        cost = bounds_of(max(1, n))
        out = min(cost[0], cost[1])
        if capped:
            return out
        down = lambda b, more=many: c(b, more, at + 1)
        options = [cost[p] + down(bits) for p in (10, 11, 12, 13, 14, 15)]
        if many:
            both = min(down(bits, True), down(bits, False))
            options += [cost[2] + 2 * both, cost[3] + both, cost[20] + both, cost[21] + both]
        options += [cost[30] + down(k) + down(bits - k) for k in range(1, bits)]
        if d.is_float and bits == d.bits:
            options.append(cost[31] + down(1) + down(d.exponent) + down(d.mantissa))
        if bits > 1:
            options.append(cost[32] + bits * down(1))
        if bits > 8:
            options.append(cost[33] + bits // 8 * down(8) + (down(bits % 8) if bits % 8 else 0))
        return min(out, *options)

    return c


def synthesize(words: np.ndarray, dtype: str, config: Config = Config(), prior: Prior | None = None) -> Result:
    words, bits = np.asarray(words, np.uint32), DTYPES[dtype].bits
    if bits < 32 and len(words) and int(words.max()) >> bits:
        raise EngineError("TypeMismatch", dtype)
    best = [Choice("Lit")]
    best_bytes = HEADER + size(lit(words, bits))
    if config.expansions <= 0 or not len(words):
        return Result(lit(words, bits), best_bytes, "budget_exhausted" if len(words) else "proven_optimal", 0, 0)
    prior = prior or Prior()
    bounds = lru_cache(None)(lambda n: prior.bounds(n))
    least = completion_costs(dtype, bounds, config.limits.depth) if config.heuristic else None
    ahead = lambda h: least(h.bits, h.n > 1, h.depth) if least and h.n else 0
    known: dict[tuple, int] = {}  # bytes of the literals that have been sized, by where they come from
    expanded = completed = serial = 0
    cut = None

    def assemble(path: list[Choice]) -> Node:
        rest = iter(path)

        def make(w, b):
            c = next(rest)
            return build(c, w, b, [make(child(c, w, b, i), k) for i, (_, k) in enumerate(shapes(c, len(w), b))])

        return make(words, bits)

    def total_bytes(path: list[Choice]) -> int:
        rest = iter(path)

        def of(at: _Branch, n: int) -> int:
            c = next(rest)
            if c.family == "Lit":
                key = at.key()
                if key not in known:
                    known[key] = size(lit(at.words(), at.bits))
                return known[key]
            return fixed_bytes(c, at.words(), at.bits) + sum(of(_Branch(None, b, at, c, i), k) for i, (k, b) in enumerate(shapes(c, n, at.bits)))

        return HEADER + of(_Branch(words, bits), len(words))

    def leftmost(path: list[Choice]) -> _Branch:
        waiting = [_Branch(words, bits)]
        lengths = [len(words)]
        for c in path:
            at, n = waiting.pop(), lengths.pop()
            below = shapes(c, n, at.bits)
            waiting += [_Branch(None, b, at, c, i) for i, (_, b) in reversed(list(enumerate(below)))]
            lengths += [k for k, _ in reversed(below)]
        return waiting[-1]

    def consider(path: list[Choice]) -> None:
        nonlocal best, best_bytes
        total = total_bytes(path)
        if total < best_bytes:
            best, best_bytes = path, total

    if config.seed_float and DTYPES[dtype].is_float and config.nodes >= 4 and config.limits.depth >= 1:
        consider([Choice("MergeFloat", dtype), Choice("Lit"), Choice("Lit"), Choice("Lit")])
    root = _Hole(len(words), bits, 0, ROOT, 0)
    queue = [(ahead(root), HEADER + 1, 0, 0, HEADER, [], [root])]
    frontier = None
    while queue:
        f, low, _, g, fixed, path, holes = heapq.heappop(queue)
        if low >= best_bytes:
            continue
        if not holes:
            completed += 1
            consider(path)
            continue
        if len(path) + len(holes) > config.nodes:
            continue
        if expanded >= config.expansions:
            cut = low if cut is None else min(cut, low)
            if frontier is None or (f, low) < frontier[:2]:
                frontier = (f, low, path, holes)
            continue
        expanded += 1
        hole, rest = holes[0], holes[1:]
        own_words = leftmost(path).words()
        choices = propose(own_words, hole.bits, dtype, hole.depth, config.limits)
        admitted = sorted({c.id for c in choices})
        cost = prior.costs(context(own_words, hole.bits, dtype, hole.parent, hole.slot, hole.depth) if not prior.empty else (), admitted) if not prior.empty else dict.fromkeys(admitted, log_cost(1, len(admitted)))
        open_ = sum(h.n * storage(h.bits) for h in rest)
        for c in choices:
            if open_ + storage_bytes(c, hole.n, hole.bits) > config.open_bytes:
                continue
            kids = [_Hole(k, b, hole.depth + 1, c.id, min(i, 255)) for i, (k, b) in enumerate(shapes(c, hole.n, hole.bits))]
            after = kids + rest
            if len(path) + 1 + len(after) > config.nodes:
                continue
            total = fixed + fixed_bytes(c, own_words, hole.bits)
            bound = total + len(after)
            if bound >= best_bytes:
                continue
            serial += 1
            own = g + cost[c.id]
            item = (own + sum(map(ahead, after)), bound, serial, own, total, [*path, c], after)
            if len(after) > config.expansions - expanded:  # can't be finished in the budget
                cut = bound if cut is None else min(cut, bound)
                if frontier is None or item[:2] < frontier[:2]:
                    frontier = (item[0], bound, item[5], after)
            else:
                heapq.heappush(queue, item)
    if frontier is not None and frontier[1] < best_bytes:
        consider([*frontier[2], *[Choice("Lit")] * len(frontier[3])])
    made = assemble(best)
    if made.kind != "Lit" and not np.array_equal(execute(made), words):
        raise EngineError("InternalError", "a program doesn't give its stream")
    return Result(made, best_bytes, "proven_optimal" if cut is None or cut >= best_bytes else "budget_exhausted", expanded, completed)


def observe(prior: Prior, p: Node, words: np.ndarray, bits: int, dtype: str, weight: int = 1, parent: int = ROOT, slot: int = 0, depth: int = 0) -> None:
    """Counts every production of a program in its context; the program must give the words."""
    left = type_of(p.children[0])[1] if p.kind == "Concat" else 0
    c = choice_of(p, left)
    prior.observe(context(words, bits, dtype, parent, slot, depth), c.id, weight)
    for i, ((w, b), kid) in enumerate(zip(children(c, words, bits), p.children)):
        observe(prior, kid, w, b, dtype, weight, c.id, min(i, 255), depth + 1)


