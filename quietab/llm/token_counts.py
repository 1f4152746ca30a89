"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at
each character; dynamic programming carries only the best score and the piece
count of the best path.  The rules are the ``tokenizers`` library's Unigram
model's: a candidate replaces the best one only if its score is strictly
larger, candidates of one end come longest first; a character that is no piece
of its own may be unknown at the smallest score minus 10; an unknown counts its
UTF-8 bytes if the vocabulary has all byte pieces, else a run of unknowns
counts one.  Texts are normalised as by Prepend and Replace: a word-start mark before a
non-empty text, and for every space.

No piece of a usual vocabulary has the mark after another character, nor a line
feed beside one, so the best path splits there and every distinct chunk is
counted once per worker (a bounded cache).  The split is used only if the vocabulary allows it: no such
piece, whole-number scores (their sums are exact) and byte pieces; otherwise
whole texts are run.  Plan: one shuffle-free scan.

Defined cases: a null or empty text has 0 tokens; repeated rows are each
counted; ties follow the rule above.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quietab.llm.common import map_text, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 500_000
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType())]


def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) in id order of a sentencepiece file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))


class Counter:
    def __init__(self, vocab, unk_id: int = 0):
        scores = dict(vocab)
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.auto = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.cut = (self.bytes and all(float(s).is_integer() for _, s in vocab)
                    and not any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1) for p, _ in vocab))
        self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.known: dict[str, int] = {}

    def path_count(self, s: str) -> int:
        """Pieces on the best path of a normalised text."""
        n = len(s)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        end, found, single = 0, False, True
        last_bytes = self.bytes

        def close():
            if not single:
                score = best[end - 1] + self.unknown
                if not found or score > best[end]:
                    best[end] = score
                    count[end] = count[end - 1] + (len(s[end - 1].encode()) if last_bytes else not unk[end - 1])
                    unk[end] = True

        for at, (size, score) in self.auto.iter(s):
            at += 1
            while end < at:
                close()
                end, found, single = end + 1, False, False
            start = at - size
            score += best[start]
            if not found or score > best[at]:
                best[at], count[at], found = score, count[start] + 1, True
            single = single or size == 1
        while end < n:
            close()
            end, found, single = end + 1, False, False
        close()
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        if not self.cut:
            return self.path_count(s)
        chunks = self.chunks(s)
        got = list(map(self.known.get, chunks))
        if None in got:
            new = {c for c, k in zip(chunks, got) if k is None}
            if len(self.known) + len(new) > CACHE_CHUNKS:
                self.known.clear()
                new = set(chunks)
            for c in new:
                self.known[c] = self.path_count(c)
            got = map(self.known.__getitem__, chunks)
        return sum(got)


@lru_cache(2)
def _counter(vocab) -> Counter:
    return Counter(vocab)


def token_counts(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """n_tokens and n_chars of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def make():
        counter = _counter(shared.value)

        def f(block):
            texts = [t.decode("utf-8", "replace") if t else "" for t in block]
            return {"n_tokens": np.fromiter(map(counter.count, texts), np.int64, len(texts)),
                    "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))}
        return f

    return map_text(docs, FIELDS, make, keep=keep)


def op5_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
