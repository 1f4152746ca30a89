"""Re-Pair grammar compression of id sequences, in numpy.

Frequent adjacent id pairs are replaced by new ids (nonterminals) again and
again.  A round counts all pairs of the shard, takes every pair that occurs at
least ``least`` times, the most frequent ones first where two would share an id, and
replaces their occurrences from left to right; ``least`` starts at a quarter of
the largest count and falls to a quarter from round to round down to ``min_count``, where rounds go on
until no pair occurs so often.  Pairs never reach across a document's end, so any document can be
decoded alone; the stored expansion lengths give any id range without
expanding what lies before it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIQIQIBQ")  # magic, documents, ids, rules, symbols, terminals, bytes a length, escaped symbols
#: a symbol that does not fit 16 bits is written as this and listed behind the others
ESCAPE = (1 << 16) - 1


CELLS = 1 << 20
#: bits of a symbol (terminal or rule); a pair of them is one 64-bit code
SYMBOL_BITS = 31


def _cell(seq: np.ndarray) -> np.ndarray:
    """Hash cell of each pair of neighbours."""
    u = seq.view(np.uint32)
    return ((u[:-1] * np.uint32(0x9E3779B1) + u[1:] * np.uint32(0x85EBCA77)) >> np.uint32(12)).astype(np.int64)


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur at least ``least`` times, and their counts."""
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(code)))
    ok = count >= least
    return code[first[ok]], count[ok]


def _chosen(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of occurrences to replace: no two next to each other; equal pairs
    from the left, else the better rank first."""
    keep = np.ones(len(at), bool)
    touch = (at[1:] == at[:-1] + 1) & (rank[1:] == rank[:-1])
    start = np.flatnonzero(np.concatenate(([True], ~touch))) if len(at) else at
    run = np.repeat(start, np.diff(np.append(start, len(at))))
    keep &= (np.arange(len(at)) - run) % 2 == 0
    at, rank, origin = at[keep], rank[keep], np.flatnonzero(keep)
    taken = np.zeros(len(keep), bool)
    while len(at):
        next_to = at[1:] == at[:-1] + 1
        worse = np.zeros(len(at), bool)
        worse[1:] |= next_to & (rank[:-1] <= rank[1:])
        worse[:-1] |= next_to & (rank[1:] < rank[:-1])
        won = ~worse
        taken[origin[won]] = True
        gone = won.copy()
        gone[1:] |= next_to & won[:-1]
        gone[:-1] |= next_to & won[1:]
        at, rank, origin = at[~gone], rank[~gone], origin[~gone]
    return taken


def re_pair(ids: np.ndarray, ends: np.ndarray, terminals: int, min_count: int = 8,
            fall: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, end of each document in symbols, rules (n, 2)) of the sequence
    whose documents end (exclusively) at ``ends``.  Rounds repeat at the last threshold until no pair
    occurs ``min_count`` times; rules end only where a symbol would need more than ``SYMBOL_BITS``."""
    if terminals > 1 << SYMBOL_BITS:
        raise ValueError(f"ids of more than {SYMBOL_BITS} bits")
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list = []
    least, newest = None, 0  # in rounds at the last threshold only pairs with a newer symbol can reach it again
    while len(seq) > 1 and (room := (1 << SYMBOL_BITS) - terminals - len(rules)) > 0:
        final = least == min_count
        if final and newest:
            fresh = seq >= newest
            at = np.flatnonzero((fresh[1:] | fresh[:-1]) & ~last[:-1])
        else:
            cell = _cell(seq)
            times = np.bincount(cell, minlength=CELLS)  # of a pair's hash cell: an upper bound that spares sorting the rest
            if not final:
                least = max(min_count, (int(times.max()) if least is None else least) // fall)
            maybe = (times >= least)[cell]
            maybe &= ~last[:-1]
            at = np.flatnonzero(maybe)
        code = seq[at].astype(np.int64) << SYMBOL_BITS | seq[at + 1]
        pair, count = _frequent(code, least)
        best = np.argsort(-count, kind="stable")[:room]
        pair = pair[best]
        by_code = np.argsort(pair)
        known = pair[by_code]
        made = np.zeros(0, np.int64)
        if len(pair):
            slot = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[slot] == code
            at, rank = at[hit], by_code[slot[hit]]
            taken = _chosen(rank, at)
            at, rank = at[taken], rank[taken]
            useful = np.bincount(rank, minlength=len(pair)) >= 3
            made = pair[useful]
        if not len(made):
            if final and not newest:
                break
            newest = 0  # nothing left beside the new symbols: one look at all pairs
            continue
        at, rank = at[useful[rank]], rank[useful[rank]]
        name = np.cumsum(useful) - 1 + terminals + len(rules)
        newest = terminals + len(rules) if least == min_count else 0
        rules.extend(made.tolist())
        seq[at] = name[rank]
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
    made = np.array(rules, np.int64)
    pairs = np.stack((made >> SYMBOL_BITS, made & ((1 << SYMBOL_BITS) - 1)), 1) if len(made) else np.zeros((0, 2), np.int64)
    return seq, np.flatnonzero(last) + 1, pairs


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    size = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[terminals + k] = size[a] + size[b]
    return size[terminals:]


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    seq = symbols.astype(np.int64)
    while True:
        more = seq >= terminals
        if not more.any():
            return seq.astype(np.uint32)
        rule = rules[seq[more] - terminals]
        at = np.cumsum(1 + more) - 1 - more
        out = np.repeat(seq, 1 + more)
        out[at[more]] = rule[:, 0]
        out[at[more] + 1] = rule[:, 1]
        seq = out


@dataclass
class Shard:
    """A decoded header and its arrays; the documents stay compressed until asked for."""
    doc_ids: np.ndarray
    has_id: np.ndarray
    ends: np.ndarray      # documents' ends in symbols
    rules: np.ndarray
    lengths: np.ndarray   # expansion length of each rule
    symbols: np.ndarray
    terminals: int
    n_ids: int

    def all_ids(self) -> np.ndarray:
        """All ids at once: every symbol's expansion is copied from a table of all rules' expansions."""
        of_rules = expand(np.arange(len(self.rules)) + self.terminals, self.rules, self.terminals)
        table = np.concatenate((np.arange(self.terminals, dtype=np.uint32), of_rules))
        place = np.int32 if max(self.n_ids, len(table)) < 1 << 30 else np.int64
        size = np.concatenate((np.ones(self.terminals, place), self.lengths.astype(place)))
        first = np.cumsum(size, dtype=place) - size
        n = size[self.symbols]
        ends = np.cumsum(n, dtype=place)
        at = np.repeat(first[self.symbols] - (ends - n), n)
        at += np.arange(self.n_ids, dtype=place)
        return table[at]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[(self.ends[k - 1] if k else 0):self.ends[k]], self.rules, self.terminals)

    def sizes(self) -> np.ndarray:
        """Number of ids that each symbol stands for."""
        size = np.ones(len(self.symbols), np.int64)
        more = self.symbols >= self.terminals
        size[more] = self.lengths[self.symbols[more].astype(np.int64) - self.terminals]
        return size

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the shard, expanding only the symbols that cover them."""
        upto = np.cumsum(self.sizes())
        a, b = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
        before = int(upto[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.terminals)[start - before:stop - before]


def packed_shard(ids: np.ndarray, counts: np.ndarray, doc_ids: list, terminals: int, **options) -> bytes:
    """The shard file of documents with ``counts`` ids each (at least one each)."""
    symbols, ends, rules = re_pair(ids, np.cumsum(counts), terminals, **options)
    rare = symbols >= ESCAPE if terminals + len(rules) > ESCAPE else np.zeros(0, bool)
    lengths = expansion_lengths(rules, terminals)
    sizes = "<u2" if lengths.max(initial=0) < 1 << 16 else "<u4"
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join((
        HEAD.pack(MAGIC, len(counts), len(ids), len(rules), len(symbols), terminals, int(sizes[-1]), int(rare.sum())),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), ends.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype(sizes).tobytes(),
        (np.where(rare, ESCAPE, symbols) if len(rare) else symbols).astype("<u2").tobytes(),
        symbols[rare].astype("<u4").tobytes() if len(rare) else b""))


def opened(data: bytes) -> Shard:
    magic, docs, n_ids, n_rules, n_symbols, terminals, size, n_rare = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = HEAD.size

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, known, ends = take("<i8", docs), take("u1", docs), take("<u4", docs)
    rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
    lengths, symbols = take(f"<u{size}", n_rules), take("<u2", n_symbols)
    if n_rare:
        symbols = symbols.astype(np.uint32)
        symbols[symbols == ESCAPE] = take("<u4", n_rare)
    return Shard(doc_ids, known.astype(bool), ends, rules, lengths, symbols, terminals, n_ids)
