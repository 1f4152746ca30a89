"""Pieces of the training-data operators against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from quietab.llm import decontam, grammar, licences, packing, quality, simhash, token_counts, tokens

rnd = random.Random(5)
ODD = ["", "  ", " a  b\n\n c\t d ", "it's  we'll x\xa0y", "\x1c a\x1fb", "é ́a", "a \nb", "<|endoftext|> x",
       "ÀÉ Ça İ ΣΑΣ ﬁ", "日本語 テ", "a\x85b", "'s's 'S don't,y",
       "12 345a6", "​ z", "\U0001f642 \U0001f44d!!", "\xe9t\xe9́x,\xb5a"]


def random_texts(alphabet, n, longest=30):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_encoding_is_the_tokenizers(name, spaced):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    enc = tokens.Encoder(whole.to_str(), spaced, capacity=50)  # forgets often
    texts = ODD + random_texts(" \n\t  abcÉé1!'s ́\x1e'll,.", 1500)
    for token in ("<|startoftext|>", "<|endoftext|>"):  # as the untouched library: at starts, ends, inside words, in a row
        texts += [token, token * 3, f"a {token} b", f"a{token}b", f"{token} x", f"x {token}", f"é\n{token}\n\n z", token[:-1], token.upper()]
    texts += ["".join(rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", "ab", "É", "'s"]) for _ in range(8))
              for _ in range(400)]
    for lo in range(0, len(texts), 40):
        part = texts[lo:lo + 40]
        ids, n = enc.encode([t.encode() for t in part] + [None])
        ends = np.cumsum(n)
        assert ids.dtype == np.uint32
        for t, a, b in zip(part, ends - n, ends):
            assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
        assert n[-1] == 0


def test_unigram_counts_are_the_tokenizers():
    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.Counter(vocab)
    assert counter.cut
    norm = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    whole = Tokenizer(models.Unigram(list(vocab), 0, True))
    whole.normalizer = norm
    for t in ODD + ["<s> <0x0A> <unk>"] + random_texts("aeth r▁\n\xf1\U0001f642<s>0xA", 800):
        assert counter.count(t) == len(whole.encode(t).ids), repr(t)
    for k in range(60):  # ties, no byte pieces, scores that are no whole numbers
        small = {"<unk>": 0.0}
        for _ in range(rnd.randint(2, 12)):
            small["".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 4)))] = -rnd.randint(1, 4) * (1.0 if k % 2 else 0.37)
        whole = Tokenizer(models.Unigram(list(small.items()), 0, False))
        whole.normalizer = norm
        counter = token_counts.Counter(tuple(small.items()))
        assert not counter.cut
        for t in random_texts("abcd ", 20, 15):
            assert counter.count(t) == len(whole.encode(t).ids), (small, t)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for t in range(120):
        counts = rng.integers(1, 40, rng.integers(1, 30))
        ids = rng.integers(0, rng.integers(1, 6), counts.sum()) if t % 3 else np.full(counts.sum(), 2)
        names = [None if k == 1 else k for k in range(len(counts))]
        shard = grammar.opened(grammar.packed_shard(ids.astype(np.uint32), counts, names, 10, min_count=2))
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends)):
            assert (shard.document(k) == ids[a:b]).all() and shard.has_id[k] == (names[k] is not None)
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        if a < b:
            assert (shard.ids(a, b) == ids[a:b]).all()
        if t % 3 == 0 and len(ids) > 100:
            assert len(shard.symbols) < len(ids)
    with pytest.raises(ValueError):
        grammar.opened(b"x" * 64)


def test_packing_keeps_every_id_and_fills_all_but_one():
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 1023) for _ in range(rnd.randint(0, 200))], np.int64)
        plain = packing.first_fit_decreasing(sizes, 1024)
        free = [1024 - sum(sizes[i] for i in b) for b in plain]
        assert min(free, default=0) >= 0
        order = [i for b in plain for i in b]
        assert sorted(order) == list(range(len(sizes)))
        bins = packing.packed(sizes, 1024)
        have = np.zeros(len(sizes), np.int64)
        for i, start, n in sorted(p for b in bins for p in b):
            assert start == have[i]
            have[i] += n
        assert (have == sizes).all()
        used = [sum(p[2] for p in b) for b in bins]
        assert max(used, default=0) <= 1024 and sum(u < 1024 for u in used) <= 1


def test_first_fit_is_first_fit():
    sizes = np.array([rnd.randint(1, 50) for _ in range(300)], np.int64)
    want: list = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b in want:
            if sum(sizes[j] for j in b) + sizes[i] <= 100:
                b.append(i)
                break
        else:
            want.append([i])
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_golay_keys_meet_at_three_bits():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 2, 3):
        x = rng.integers(0, 2**64, 600, dtype=np.uint64)
        y = x.copy()
        for _ in range(bits):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        row, key, _ = simhash.bucket_keys(x)
        far = set(zip(row.tolist(), key.tolist()))
        row, key, own = simhash.bucket_keys(y)
        met = {r for r, k in zip(row[own].tolist(), key[own].tolist()) if (r, k) in far}
        assert met == set(range(len(x)))


def test_long_runs_give_a_spanning_forest():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for c in centre]))
    pairs = [p for a, b in simhash.verified(np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool), 3)
             for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(fps) - 3
    assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in pairs)


def plain_fingerprint(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "a B", "\xc9t\xe9 x\xa0y z", *random_texts("ab cD\n\t\x0b.", 300, 60)]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t), repr(t)


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edits_found_are_the_fewest_within_the_budget():
    cfg, hits = decontam.LeakConfig(), 0
    for _ in range(25):
        items = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 7)))
                          for _ in range(rnd.randint(1, 25))).encode() for _ in range(5)]
        docs = [None, b""]
        for _ in range(6):
            p = list(rnd.choice(items).decode())
            for _ in range(rnd.randint(0, 12)):
                x = rnd.randrange(len(p) + 1)
                p[x:x + rnd.randint(0, 1)] = rnd.choice(["", "a", "e"])
            docs.append(("".join(rnd.choices("abcde ", k=60)) + "".join(p) + "".join(rnd.choices("abcde ", k=40))).encode())
        index = decontam.ItemIndex(items, cfg)
        got = {(d, i): e for d, i, e, _ in decontam.found(index, docs)}
        for d, t in enumerate(docs):
            for i, item in enumerate(items):
                fewest, k = semi_global(item, decontam.normalised(t)), int(index.edits[i])
                want = fewest if fewest <= k and len(item) >= cfg.q else None
                assert got.get((d, i)) == want
                hits += want is not None
    assert hits > 50


def test_common_grams_lose_nothing(monkeypatch):
    monkeypatch.setattr(decontam, "COMMON", 2)
    head = b"which of the following is the right answer "
    items = [head + bytes(rnd.choices(b"abcdefg ", k=120)) for _ in range(8)] + [head]
    index = decontam.ItemIndex([decontam.normalised(t) for t in items], decontam.LeakConfig())
    docs = [b"x y z " + t + b" and more" for t in items]
    got = {(d, i) for d, i, *_ in decontam.found(index, docs)}
    assert {(d, d) for d in range(len(docs))} <= got


def test_automaton_matching_statistics_and_places():
    for _ in range(120):
        seqs = [rnd.choices([b"a", b"b", b"c"], k=rnd.randint(1, 7)) for _ in range(rnd.randint(1, 4))]
        gsa = licences.Automaton(seqs)
        ends = {}
        for k, s in enumerate(seqs):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    ends.setdefault(tuple(s[i:j]), set()).add((k, j))
        text = rnd.choices([b"a", b"b", b"c", b"d"], k=15)
        for i, (state, n) in enumerate(gsa.stream(text), 1):
            assert n == max((m for m in range(1, i + 1) if tuple(text[i - m:i]) in ends), default=0)
            if n:
                assert set(gsa.places[state]) == ends[tuple(text[i - n:i])]


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for p, label in licences.PHRASES.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licence_base_places_and_spans():
    scan = licences.default_scanner()
    words = ["GNU", "general", "Public", "license", "apache", "MIT", "cc", "by", "x", "caf\xe9", ".", "-"]
    texts = [None, "", "CC BY-NC", *(" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(500)),
             *licences.TEMPLATES.values()]
    for t in texts:
        got = scan.scan(licences.words_of(t.encode() if t is not None else None))
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain_base(t)
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))
    for name, t in licences.TEMPLATES.items():
        broken = t.replace("ou", "u", 1) if len(t) > 200 else t
        assert name in scan.scan(licences.words_of(f"some words {broken} more words".encode()))["labels"].split(",")
    assert scan.scan(licences.words_of(b"nothing here at all"))["labels"] == ""


def test_licence_chains_across_insertions_and_repeats():
    scan = licences.default_scanner()
    words = licences.TEMPLATES["mit-text"].split()
    cut = len(words) * 55 // 100
    inserted = " ".join(f"inserted{i}" for i in range(10)).split()
    got = scan.scan(licences.words_of(" ".join(words[:cut] + inserted + words[cut:]).encode()))
    spans = [s for s in got["spans"] if s["template"] == "mit-text"]
    assert "mit-text" in got["labels"].split(",") and got["score"] == 1.0
    assert len(spans) == 2 and all(s["cover"] < 0.75 for s in spans) and spans[0]["end"] + 10 == spans[1]["start"]
    twice = scan.scan(licences.words_of(" ".join(words + inserted + words).encode()))
    assert [s["cover"] for s in twice["spans"] if s["template"] == "mit-text"] == [1.0, 1.0]
    # "a b c" occurs twice in the template: the later place carries the chain on
    own = licences.Scanner({}, {"t": "a b c d e f g h i j a b c k l m n o p q"})
    assert own.scan(b"d e f g h i j x a b c y k l m n o p q".split())["labels"] == "t"
    for _ in range(300):
        segments, a, b = [], 0, 0
        for _ in range(rnd.randint(1, 7)):
            a += rnd.randint(1, 4)
            b = max(b + 1, a + rnd.randint(1, 4))
            segments.extend((a, b, e) for e in sorted({rnd.randint(b - a, 12 + b - a) for _ in range(2)}))
        for gap in (None, 2):
            want = []
            for i, (a1, b1, e1) in enumerate(segments):
                want.append(max([b1 - a1] + [want[j] + min(b1 - a1, b1 - b0, e1 - e0) for j, (_, b0, e0) in enumerate(segments[:i])
                                            if b0 < b1 and e0 < e1 and (gap is None or a1 - b0 <= gap)]))
            assert licences.chains(segments, gap)[0] == want


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    again = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_quality_base_counts():
    for t in [None, "", "\n\n", "a\na\n a\n", *random_texts("ab \n\t#|\xe9\U0001f642\x85", 800, 80)]:
        assert quality.base_counts(t.encode() if t is not None else None) == plain_quality(t), repr(t)


def test_gram_cells_stay_inside_texts():
    data = np.frombuffer(b"abcdef\x00ab\x00abcd\x00", np.uint8)
    starts, lens = np.array([0, 7, 10]), np.array([6, 2, 4])
    inside = quality.gram_weights(lens, starts, len(data) - 3, 4)
    assert np.flatnonzero(inside).tolist() == [0, 1, 2, 10]
    assert zlib.crc32(quality.gram_cells(data, 4, 1 << 16).tobytes()) == zlib.crc32(quality.gram_cells(data, 4, 1 << 16).tobytes())


def test_large_sparse_runs_are_split_and_keep_every_link(monkeypatch):
    """A bucket of distinct fingerprints, most without a link: its components are those of all pairs."""
    import numpy as np
    from quietab.llm import simhash
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 6000).astype(np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 40, 1500).astype(np.uint64))
    chain = [base[0]]
    for k in range(30):
        chain.append(chain[-1] ^ (np.uint64(7) << np.uint64(k)))
    dense = base[7] ^ np.array([(1 << a) | (1 << b) for a in range(40) for b in range(a)], np.uint64)
    fps = np.unique(np.concatenate((base, near, np.array(chain, np.uint64), dense)))
    own = rng.random(len(fps)) < 0.7
    monkeypatch.setattr(simhash, "SEARCHES", 8)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    for a, b in simhash.verified(np.zeros(len(fps), np.int64), fps, own, 3):
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 3
            links += 1
            root[find(x)] = find(y)
    got = {int(f): find(int(f)) for f in fps}
    plain = {int(f): int(f) for f in fps}

    def of(x):
        while plain[x] != x:
            plain[x] = plain[plain[x]]
            x = plain[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero((np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3) & (own[i + 1:] | own[i])) + i + 1:
            plain[of(int(fps[i]))] = of(int(fps[j]))
    groups = {}
    for f in got:
        groups.setdefault(of(f), set()).add(got[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(got.values()))
    assert links < 40 * len(fps)  # never all pairs


def test_a_million_rows_under_one_key_end_in_bounded_time():
    import time

    import numpy as np
    from quietab.llm import simhash
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 60, 1_000_000).astype(np.uint64))
    fps = np.unique(np.concatenate((fps, fps[:5000] ^ np.uint64(5))))
    began = time.monotonic()
    found = {frozenset((int(x), int(y))) for a, b in simhash.verified(np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool), 3)
             for x, y in zip(a, b)}
    assert len(found) >= 5000 and time.monotonic() - began < 120


def test_re_pair_goes_on_until_no_pair_is_frequent():
    from collections import Counter

    import numpy as np
    from quietab.llm import grammar
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 500, 60)
    ids = np.concatenate([np.concatenate((phrase, rng.integers(0, 500, 30))) for _ in range(400)]).astype(np.uint32)
    ends = np.arange(90, len(ids) + 1, 90)
    symbols, at, rules = grammar.re_pair(ids, ends, 500)
    assert np.array_equal(grammar.expand(symbols, rules, 500), ids)
    inside = np.ones(len(symbols), bool)
    inside[at - 1] = False
    code = symbols[:-1].astype(np.int64) << 31 | symbols[1:]
    assert Counter(code[inside[:-1]].tolist()).most_common(1)[0][1] < 8
    assert len(rules) > 50 and len(symbols) < 0.5 * len(ids)


def test_symbols_beyond_sixteen_bits():
    import numpy as np
    from quietab.llm import grammar
    rng = np.random.default_rng(6)
    for terminals in (40_000, 65_530, 65_536, 100_000, 1 << 24):
        ids = np.concatenate([rng.integers(max(0, terminals - 300), terminals, 20)] * 200).astype(np.uint32)
        ids[7] = min(terminals - 1, 65_535)
        shard = grammar.opened(grammar.packed_shard(ids, np.full(200, 20), list(range(200)), terminals))
        assert len(shard.rules) > 6
        assert np.array_equal(np.concatenate([shard.document(k) for k in range(200)]), ids)
        if terminals < 1 << 20:
            assert np.array_equal(shard.all_ids(), ids) and np.array_equal(shard.ids(30, 77), ids[30:77])
