"""The substring operators decide through their index, whatever the texts' sizes, keys and batches are."""

import collections
import random

import pyarrow as pa
import pytest
from test_operators import brute_bytes, brute_components, brute_hits, brute_words

from treeslab.llm import decontaminate, fmindex, lattice, neardup, quality, suffixes
from treeslab.llm import repeated as R


def fronts(n):
    """Two words of n bytes over two letters that polynomial hashes modulo powers of two don't tell apart."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def many_contexts(n=20, seed=9):
    """One passage between different neighbours, so that its keys hold many contexts, and some copies."""
    rng = random.Random(seed)
    some = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(k))
    core = some(24)
    texts = [f"{some(rng.randint(0, 40))} {core} {some(rng.randint(0, 40))}" for _ in range(n)]
    return [(k, t) for k, t in enumerate([*texts, *texts[:6], texts[0], core, core])]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def got_bytes(found):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())


def got_words(found):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in found.collect())


@pytest.mark.parametrize("setting", [{"SEGMENT": 64, "HEAVY": 12}, {"KEYS_MAX": 0, "HOT": 1 << 40}])
def test_every_way_gives_the_same(spark, monkeypatch, setting):
    rows = many_contexts()
    for name, value in setting.items():
        monkeypatch.setattr(R, name, value)
    if "HOT" in setting:
        monkeypatch.setattr(R, "max", lambda *x: 1, raising=False)
    docs = frame(spark, rows)
    assert got_bytes(suffixes.dedup(docs)) == brute_bytes(rows)
    assert got_words(fmindex.dedup(docs)) == brute_words(rows)


def test_nothing_is_removed_without_the_index(spark, monkeypatch):
    def nothing(batches):
        for _ in batches:
            pass
        yield from ()

    docs = frame(spark, many_contexts())
    for module in (suffixes, fmindex):
        monkeypatch.setattr(module, "_decide", nothing)
        assert {r.n_removed for r in module.dedup(docs).collect()} == {0}


def test_index_grows_by_batches(spark, tmp_path):
    rows = many_contexts()
    index = suffixes.Index(spark, str(tmp_path / "index"))
    for part in (rows[:10], rows[10:22]):
        index.add(frame(spark, part))
    index = suffixes.Index(spark, str(tmp_path / "index"))  # read again from its folder
    assert got_bytes(index.removed(frame(spark, rows[:22]))) == brute_bytes(rows[:22])
    index.add(frame(spark, rows[22:]))
    assert len(index.levels) < 3
    assert got_bytes(index.removed(frame(spark, rows))) == brute_bytes(rows)
    with pytest.raises(ValueError):
        index.add(frame(spark, [(1, "a"), (1, "b")]))


def test_families_of_small_batches(spark, monkeypatch):
    """Levels of a task's family take in batch after batch."""
    rows = many_contexts()
    docs = frame(spark, rows, 1)
    rows_, _ = suffixes.keyed(docs)
    kind = R.Bytes(suffixes.WIDTH)
    met = R.occurrences(rows_, kind, None)
    each = R.listed(met)
    table = R.part_of(each, R.NUMBER).unionByName(R.texts_at(rows_, kind, each)).sort("digest", "key").toArrow()
    answers = []
    for size in (7, 10**6):
        monkeypatch.setattr(suffixes, "BATCH", size)
        out = list(suffixes._decide(iter(table.to_batches(max_chunksize=13))))
        answers.append(sorted((r["key"], r["digest"], str(r["runs"])) for x in out for r in x.to_pylist()))
    strip = lambda rows: collections.Counter((k, d) for k, d, _ in rows)
    assert strip(answers[0]) == strip(answers[1]) and answers[0]
    whole = lambda rows: {(k, d, i) for k, d, runs in rows for r in eval(runs) for i in range(r["start"], r["start"] + r["n"])}  # noqa: E731, S307
    assert whole(answers[0]) == whole(answers[1])


def test_long_words_of_two_letters_differ(spark):
    """Words that hashes modulo a power of two confuse; no operator takes them as equal."""
    x, y = fronts(1024)
    p, q = fronts(2048)
    rng = random.Random(4)
    mixed = [[rng.choice("xy") for _ in range(24)] for _ in range(2)]
    one = " ".join({"x": x, "y": p}[c] for c in mixed[0])
    two = " ".join({"x": y, "y": q}[c] for c in mixed[0])
    rows = [(1, one), (2, two), (3, f"{x}\n{y}\n{x}"), (4, "a b")]
    docs = frame(spark, rows)
    assert got_words(fmindex.dedup(docs)) == brute_words(rows)
    assert got_bytes(suffixes.dedup(docs)) == brute_bytes(rows)
    near = neardup.near_duplicates(docs, 85)
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in near.collect()) == brute_components(rows)
    assert {r.doc_id: r.n_dup_lines for r in quality.judge(docs, quality.Crf.blank()).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    items = [(1, " ".join(one.split()[:12]), None), (2, " ".join(two.split()[3:6]), None)]
    found = decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string, other string"))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_hits(rows, items)
    known = {r.doc_id: r.n_known for r in lattice.score(docs).collect()}
    train = [t.split() for d, t in rows if d != 2]
    assert known[2] in (1, 25) and all(isinstance(v, int) for v in known.values()) and train


def test_single_takes_whole_rows():
    rows = [(1, 1, 5, 0, None, None, None, None, 2, None), (1, 1, None, None, 3, 1, 0, 4, None, b"x"), (1, 2, 6, 1, None, None, None, None, 1, None), (2, 2, None, None, 3, 1, 0, 4, None, b"y")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    table = pa.table({x: pa.array([r[k] for r in rows], kinds[R.TYPES[x]]) for k, x in enumerate(R.NAMES)})
    assert R.single(table).to_pylist() == [dict(zip(R.NAMES, (1, 1, 5, 0, 3, 1, 0, 4, 2, b"x")))]
