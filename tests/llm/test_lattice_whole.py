"""The lattice holds every usable piece of the vocabulary."""

import base64
import collections
import math
import random
import time
import tracemalloc
import zlib

import numpy as np

from treeslab.llm import lattice


def test_long_pieces_take_part():
    with open(lattice.VOCABULARY, "rb") as lines:
        every = {base64.b64decode(line.split()[0]) for line in lines}
    usable = {x for x in every if x and not any(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\v\f\r" for c in x.removeprefix(b" "))}
    pieces = lattice.Pieces.read()
    assert set(pieces.strings) == usable
    word = " responsibilities".encode()
    start, size, piece = pieces.trie.edges(np.frombuffer(word, dtype=np.uint8), np.full(len(word), len(word)))
    assert word in usable and [pieces.strings[p] for s, n, p in zip(start, size, piece) if s == 0 and n == len(word)] == [word]


def by_hand(pieces, words):
    """Log marginals and expected uses by a recursion over dicts, one word after another."""
    log = dict(zip(pieces.strings, pieces.logs.tolist()))
    longest = max(map(len, log))
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
    uses, out = collections.Counter(), []
    for word in words:
        n = len(word)
        arcs = [(i, j, log[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in log]
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for i, j, p in arcs:
            ahead[j] = add(ahead[j], ahead[i] + p)
        for i, j, p in reversed(arcs):
            behind[i] = add(behind[i], behind[j] + p)
        out.append(ahead[n])
        for i, j, p in arcs:
            uses[word[i:j]] += math.exp(ahead[i] + p + behind[j] - ahead[n])
    return out, uses


def test_score_by_hand(spark, monkeypatch):
    """Training, whole-word arcs, pieces and ends, against the definition."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["abc" * 120]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(30)] + [(30, None), (31, words[-1])]
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    texts = {d: (t or "").split() for d, t in rows}
    counts = collections.Counter(w for d, t in texts.items() if not held(d) for w in t)
    ends = sum(not held(d) for d in texts)
    n = sum(counts.values()) + ends
    pieces = lattice.Pieces.read()
    raw = lambda w: b" " + w.encode()
    for _ in range(lattice.ROUNDS):
        _, uses = by_hand(pieces, [raw(w) for w in counts])
        weight = [uses[x] + lattice.PRIOR for x in pieces.strings]
        pieces = lattice.Pieces(pieces.strings, np.log(np.array(weight) / sum(weight)), pieces.trie)
    every = sorted({w for t in texts.values() for w in t})
    marginal = dict(zip(every, by_hand(pieces, [raw(w) for w in every])[0]))
    left = lattice.DISCOUNT * len(counts) / n
    one = lambda w: math.log10(max(counts[w] - lattice.DISCOUNT, 0) / n + left * math.exp(marginal[w])) if marginal[w] > -600 or counts[w] else (math.log(left) + marginal[w]) / math.log(10)
    for d, t in texts.items():
        assert math.isclose(got[d].score, sum(map(one, t)) + math.log10(ends / n), rel_tol=1e-9), d
        assert math.isclose(got[d].lattice_score, sum(marginal[w] / math.log(10) + math.log10(1 - ends / n) for w in t) + math.log10(ends / n), rel_tol=1e-9), d


def test_long_words_alike(monkeypatch):
    rng = random.Random(1)
    pieces = lattice.Pieces.read()
    words = [b" " + bytes(rng.choice(b"abcdexyz=/+09\xc3\xa9") for _ in range(n)) for n in (3, 700, 255, 256, 5000, 1)]
    want, uses = by_hand(pieces, words)
    for long, chunk in ((256, 100), (10**6, 1 << 15), (1, 64)):
        monkeypatch.setattr(lattice, "LONG", long)
        monkeypatch.setattr(lattice, "CHUNK", chunk)
        assert np.allclose(pieces.marginal(words), want, rtol=1e-10)
        assert np.allclose(pieces.expected(words, np.ones(len(words))), [uses[x] for x in pieces.strings], rtol=1e-7, atol=1e-9)


def test_a_megabyte_without_spaces():
    word = b" " + bytes(random.Random(2).choices(b"abcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    pieces = lattice.Pieces.read()
    began = time.process_time()
    tracemalloc.start()
    assert -1e8 < pieces.marginal([word])[0] < 0
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert time.process_time() - began < 60
