import bisect
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowspark.llm import patterns
from flowspark.llm.encoders import word_encoder

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def plain(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_equals_the_library(library):
    rng = random.Random(11)
    letters = [chr(c) for c in range(33, 127)] + list("éüßÀÿñ日😀́İΣ") + list("etaoinsr") * 12
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    words += ["don't", "IT'S", "''s", "<|endoftext|>", "<|ENDOFTEXT|>.", "<|startoftext|>x", "x" * 500, "l'été", "1234", "é", "\x85\xa0\x1c"]
    rng.shuffle(words)
    texts = [" \t\n\r\v\f"[i % 6].join(words[i:i + 40]) for i in range(0, len(words), 40)] + ["", " \n "]
    enc = word_encoder(BPE)
    for most in (1 << 18, 50):
        enc._most = most
        assert enc.data(texts) == [plain(library, t) for t in texts]
        assert enc.data(texts[:3]) == [plain(library, t) for t in texts[:3]]


def test_long_texts_are_encoded_in_slices(library, monkeypatch):
    from flowspark.llm import encoders

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcé'.1") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 300, 5, 900)]
    texts += ["x" * 400, "x" * 400 + " y"]
    want = [plain(library, t) for t in texts]
    for most in (1, 64, 500, 1 << 20):
        monkeypatch.setattr(encoders, "SLICE", most)
        assert [t for t in map("".join, map(encoders._slices, texts))] == texts
        assert word_encoder(BPE).data(texts) == want


def test_patterns_fill_exactly():
    ways = patterns.patterns(16, 3)
    assert (ways.sum(axis=1) == 16).all() and len({tuple(w) for w in ways}) == len(ways)
    # Partitions of 16 into at most three parts.
    assert len(ways) == 1 + 8 + 21 and (np.diff(ways, axis=1) <= 0).all()


def test_least_squares_meet_their_conditions():
    rng = np.random.default_rng(3)
    ways = patterns.patterns(16, 4)
    columns = np.stack([np.bincount(w, minlength=17)[1:] for w in ways], axis=1).astype(float)
    for wanted in (rng.integers(0, 50, 16), columns @ rng.integers(0, 3, len(ways)), np.eye(16)[15] * 7, np.zeros(16)):
        weights = rng.choice([0.09, 1.0], 16)
        x = patterns.nnls(ways, wanted.astype(float), weights)
        slope = (columns * weights[:, None]).T @ (weights * wanted - (columns * weights[:, None]) @ x)
        # Nothing can be gained: used columns are level, unused ones fall.
        assert (x >= 0).all() and slope.max() < 1e-5 * max(1, wanted.max()) and np.abs(slope[x > 0]).max(initial=0) < 1e-5 * max(1, wanted.max())


def best_fit(lengths):
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        i = bisect.bisect_left(rooms, x)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else 4096) - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_document_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 4097, 500), np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1),
               np.full(3000, 1), np.concatenate([np.full(999, 1365), np.full(500, 4096), np.full(7, 3000)])][seed]
    histogram = Counter(lengths.tolist())
    plan = patterns.Plan(histogram)
    used, filled = defaultdict(list), Counter()
    for length, first, sequence, offset, n in plan._runs:
        used[length].append((first, n))
        for s in range(sequence, sequence + n):
            filled[s] += length
    for length, runs in used.items():
        at = 0
        for first, n in sorted(runs):
            assert first == at
            at += n
        assert at == histogram[length]
    assert set(used) == set(histogram) and max(filled.values()) <= 4096
    assert plan.sequences <= 1.005 * best_fit(lengths) + 1
    assert seed >= 2 or plan.fitted > 0.7 * plan.sequences


def packed(rows, library, frame, window=4096):
    pieces = patterns.pattern_pack(frame, BPE, window).collect()
    texts = defaultdict(list)
    for i, text in rows:
        texts[i].append(plain(library, text) + b"\x01\0\0\0")
    sequences, seen = defaultdict(list), Counter()
    for p in pieces:
        data = [t[4 * p.start:4 * (p.start + p.length)] for t in texts[p.doc_id]]
        assert p.ids_crc32 in {zlib.crc32(d) for d in data} and p.start == p.piece * window and 0 < p.length <= window
        sequences[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id, p.piece, p.length] += 1
    want = Counter((i, k, min(window, len(t) // 4 - k * window)) for i, ts in texts.items() for t in ts for k in range(-(-len(t) // (4 * window))))
    assert seen == want
    for where in sequences.values():
        at = 0
        for offset, length in sorted(where):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences), sum(len(t) // 4 for ts in texts.values() for t in ts)


def test_pieces_of_awkward_texts(spark, library):
    rows = cases.texts()
    n, total = packed(rows, library, cases.frame(spark).repartition(5))
    assert n <= -(-total // 4096) + 1
    packed(rows, library, cases.frame(spark).repartition(2), window=300)


def test_a_hot_length_is_numbered_in_parts(spark, library, monkeypatch):
    monkeypatch.setattr(patterns, "PART_ROWS", 16)
    rows = [(i, None if i % 3 else cases.prose(i, 30 + i)) for i in range(400)] + [(7, None)] * 20
    n, total = packed(rows, library, cases.frame(spark, rows).repartition(6))
    assert n == -(-total // 4096)


def test_empty_table(spark):
    assert patterns.pattern_pack(cases.frame(spark, []), BPE).count() == 0
