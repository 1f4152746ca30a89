"""Exact tokenizer encoding with a per-worker cache of distinct chunks.

A text is cut at places that are always token boundaries of its tokenizer, so
chunks can be encoded once and looked up afterwards:

* ``words``: the tokenizer drops white space and never joins across it -- chunks
  are runs of other characters;
* ``spaced``: byte-level pre-tokenization, where one space joins the word after
  it -- chunks are an optional space with a run of other characters, or a
  run of white space without a last one that stands before a word.

ASCII letters also end a chunk where another ASCII character follows, since
letters never share a pre-token with it.  White space is Unicode White_Space, the
tokenizers' own notion.  The cuts of a block of texts are found on its bytes
(numpy) and its chunks numbered by Arrow's dictionary encoding, so Python sees
each distinct chunk of a block once; blocks with other than ASCII white space are
cut by a regular expression.  Encoding is done by the ``tokenizers`` library (its
normaliser, pre-tokenizer and model).  The library looks for the tokenizer's added tokens first, so a
text that holds one is cut there and the parts between are encoded as texts of their own;
a tokenizer whose added tokens also take blanks, whole words or normalised text is left to the
library text by text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from tokenizers import Tokenizer

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f"[^{WHITE}]+")
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: UTF-8 of white space beyond ASCII
WIDE_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: chunks of letters only (Latin-1) are one pre-token
PLAIN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch

IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
ENDS_LETTERS = ~IS_LETTER & ~IS_WHITE & (np.arange(256) < 128)

#: distinct chunks a worker remembers (about 250 bytes each) before it starts anew
CACHE_CHUNKS = 800_000

#: bytes of text that are cut and numbered at once
ENCODE_BYTES = 6 << 20


def cuts(data: np.ndarray, first: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(chunk starts and the end, whether each chunk counts) of texts joined with a
    byte after each; ``first``: the texts' starts."""
    white = IS_WHITE[data]
    pad = np.zeros(len(data), bool)
    pad[first[1:] - 1] = True
    pad[-1] = True
    start = pad.copy()
    start[1:] |= pad[:-1]
    start[0] = True
    start[1:] |= IS_LETTER[data[:-1]] & ENDS_LETTERS[data[1:]]
    after = np.zeros(len(data), bool)  # the byte before is white space
    after[1:] = white[:-1]
    if not spaced:
        start |= white != after
        at = np.flatnonzero(start)
        return np.append(at, len(data)), ~(white[at] | pad[at])
    word_next = np.zeros(len(data), bool)
    word_next[:-1] = ~white[1:] & ~pad[1:]
    space_before = np.zeros(len(data), bool)
    space_before[1:] = data[:-1] == 32
    start |= (white & (~after | word_next)) | (~white & after & ~space_before)
    at = np.flatnonzero(start)
    return np.append(at, len(data)), ~pad[at]


class Encoder:
    def __init__(self, json: str, spaced: bool, capacity: int = CACHE_CHUNKS):
        self.tokenizer = Tokenizer.from_str(json)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items() if t.content}
        self.by_library = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.find_added = re.compile(b"(" + b"|".join(longest) + b")") if longest else None
        self.model, self.spaced, self.capacity = self.tokenizer.model, spaced, capacity
        self.letters: dict[str, str] = {}
        ascii_letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        made = [self.pieces(c) for c in ascii_letters]
        #: how a chunk of ASCII letters becomes its one piece: str.lower, str, or None where neither holds
        self.plain = next((f for f in (str, str.lower) if made == [[f(c)] for c in ascii_letters]), None)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbered(self, texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct chunks, number of each chunk in turn, chunks of each text)."""
        data = b"\x00".join([*texts, b""])
        if WIDE_WHITE.search(data):
            find = (SPACED if self.spaced else WORDS).findall
            lists = [find(t.decode("utf-8", "replace")) for t in texts]
            number: dict = {}
            flat = [number.setdefault(c, len(number)) for c in chain.from_iterable(lists)]
            return [c.encode() for c in number], np.array(flat, np.int64), np.array([len(x) for x in lists])
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(lens) - lens
        raw = np.frombuffer(data, np.uint8)
        at, counts = cuts(raw, first, self.spaced)
        upto = np.concatenate(([0], np.cumsum(counts)))
        per_text = np.diff(upto[np.searchsorted(at, np.append(first, len(data)))])
        if self.spaced:
            ends, whole = at.astype(np.int32), data
        else:  # half of the chunks is white space: leave it out of the bytes
            lens = np.diff(at)
            ends = np.concatenate(([0], np.cumsum(lens[counts]))).astype(np.int32)
            whole, counts = raw[np.repeat(counts, lens)], slice(None)
        coded = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(whole)]).dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()[counts], per_text

    def pieces(self, chunk: str) -> list[str]:
        norm = self.tokenizer.normalizer
        plain = norm.normalize_str(chunk) if norm is not None else chunk
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def chunk_ids(self, chunk: str) -> list[int]:
        if PLAIN(chunk):  # one pre-token; its bytes' characters are known letter by letter
            try:
                pieces = ["".join(map(self.letters.__getitem__, chunk))]
            except KeyError:
                for c in set(chunk):
                    self.letters[c] = "\u0120" if c == " " else "".join(self.pieces(c))
                pieces = ["".join(map(self.letters.__getitem__, chunk))]
        else:
            pieces = self.pieces(chunk)
        return [t.id for p in pieces for t in self.model.tokenize(p)]

    def learn(self, chunks) -> None:
        ids: list[int] = []
        ends: list[int] = []
        plain, tokenize = self.plain, self.model.tokenize
        for c in chunks:
            if plain is not None and c.isalpha():  # ASCII letters only
                ids += [t.id for t in tokenize(plain(c.decode()))]
            elif plain is not None and c[:1] == b" " and self.spaced and c[1:].isalpha():
                ids += [t.id for t in tokenize("\u0120" + plain(c[1:].decode()))]
            else:
                ids += self.chunk_ids(c.decode("utf-8", "replace"))
            ends.append(len(ids))
        first = len(self.slot)
        self.slot.update(zip(chunks, range(first, first + len(ends))))
        n = np.diff(np.array(ends, np.int64), prepend=0)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(n) - n))
        self.size = np.concatenate((self.size, n))
        self.pool = np.concatenate((self.pool, np.array(ids, np.uint32)))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); None: empty."""
        texts = [t or b"" for t in texts]
        if self.by_library:
            lists = [self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
            return np.array(list(chain.from_iterable(lists)), np.uint32), np.array(list(map(len, lists)), np.int64)
        if self.find_added is not None and any(map(self.find_added.search, texts)):
            return self.around_added(texts)
        return self.encode_plain(texts)

    def around_added(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with added tokens: every other part of a split is such a token."""
        parts = [self.find_added.split(t) for t in texts]
        ids, counts = self.encode_plain([p for ps in parts for p in ps[::2]])
        ends = np.cumsum(counts)
        out, lens, k = [], [], 0
        for ps in parts:
            size = 0
            for i, p in enumerate(ps):
                if i % 2:
                    out.append(np.array([self.added[p]], np.uint32))
                    size += 1
                else:
                    out.append(ids[ends[k] - counts[k]:ends[k]])
                    size += int(counts[k])
                    k += 1
            lens.append(size)
        return np.concatenate(out).astype(np.uint32), np.array(lens, np.int64)

    def encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        chunks, number, per_text = self.numbered(texts)
        slots = list(map(self.slot.get, chunks))
        if None in slots:
            new = [c for c, s in zip(chunks, slots) if s is None]
            if len(self.slot) + len(new) > self.capacity:
                self.forget()
                new = chunks
            self.learn(new)
            slots = list(map(self.slot.__getitem__, chunks))
        at = np.array(slots, np.int64)
        n = self.size[at][number]
        ends = np.cumsum(n)
        place = np.int32 if max(len(self.pool), int(n.sum())) < 1 << 30 else np.int64
        where = np.repeat(self.first[at].astype(place)[number] - (ends - n).astype(place), n)
        where += np.arange(len(where), dtype=place)
        ids = self.pool[where]
        upto = np.concatenate(([0], ends))[np.cumsum(per_text)]
        return ids, np.diff(np.concatenate(([0], upto)))


@lru_cache(4)
def _encoder(digest: int, json: str, spaced: bool) -> Encoder:
    return Encoder(json, spaced)


def shared_tokenizer(sc: SparkContext, path: str) -> Broadcast:
    """The tokenizer file's text (a few MB), read by the driver."""
    with open(path, encoding="utf-8") as f:
        return sc.broadcast(f.read())


def encoder(shared: Broadcast, spaced: bool) -> Encoder:
    """This worker's encoder; it and its cache serve later tasks, too."""
    json = shared.value
    return _encoder(zlib.crc32(json.encode()), json, spaced)
