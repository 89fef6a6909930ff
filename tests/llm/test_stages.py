"""The pipeline's stages on odd rows, and the whole pipeline against plain Python."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_hits, brute_targets, shingles
from test_pii_surrogates import KEY, brute

import corpus_pipeline
from treeslab.llm import pii, quality, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_copies int, `a.b` string, rid long"


def rows_of(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + "."
    good = lambda: "\n".join(some(rng.randint(8, 20)) for _ in range(rng.randint(2, 5)))
    junk = lambda: "\n".join(" | ".join(x.upper() + "!!" for x in rng.choices(vocabulary, k=9)) for _ in range(4))
    texts = [good() if k % 5 else junk() for k in range(60)]
    texts += [texts[1], texts[1], texts[1].replace(".", " ,", 1), texts[2] + " tail"]
    texts += [None, "", " \n ", "word", "x" * 3000, "say it " * 30, good() + " Write to ann@example.org, John Smith, 10.1.2.3.", " ".join(good() for _ in range(60))]
    rows = [(k, t, "en", ["a", "b", None, "c"][k % 4], 1, 7, "z", k) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, good(), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, texts = rows_of()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 0 if k % 5 == 0 else 1) for k in range(40)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(texts[6].split()[3:16])), (2, None), (None, "one two"), (3, "!!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows, items


def test_whole_pipeline_by_hand(spark, tables, monkeypatch):
    """Each stage's decisions on what the one before kept; the CRF's verdict is the trained model's, all else is worked out anew."""
    folder, rows, items = tables
    monkeypatch.setattr(corpus_pipeline, "TEST_KEY", KEY)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    crf = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {(r.doc_id, r.n_words) for r in quality.judge(docs, crf).where("kept").collect()}
    left = [r for r in rows if (r[0], len((r[1] or "").split())) in kept]
    assert 30 < len(left) < len(rows) and all(r[1] and len(r[1].split()) >= 10 for r in left)
    order = sorted(left, key=lambda r: (r[0] is not None, r[0] or 0))
    sets = [shingles(r[1]) for r in order]
    top = list(range(len(order)))
    find = lambda k: k if top[k] == k else find(top[k])
    for a in range(len(order)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    left = [r for k, r in enumerate(order) if find(k) == k]
    assert 0 < len(order) - len(left) < 10
    triples = [(i, t, None) for i, t in items]
    left = [r for r in left if brute_hits([r[:2]], triples)[0].endswith("False)")]
    left = [(r[0], brute(r[1])[0], *r[2:]) for r in left]
    assert any("@" in r[1] for r in left) and not any("John Smith" in r[1] for r in left)
    sizes = collections.Counter()
    for r in left:
        sizes[r[3]] += len(r[1].split())
    goals = brute_targets(sizes)
    place = lambda r: int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)
    want = []
    for s, goal in goals.items():
        mine = sorted((r for r in left if r[3] == s), key=place)
        whole, rest, total, taken = int(goal / sizes[s] + 1e-12), goal - int(goal / sizes[s] + 1e-12) * sizes[s], 0, set()
        for r in mine:  # as long as it comes nearer to what is left
            n = len(r[1].split())
            if rest >= 0.5 and (total + n <= rest or total <= rest and total + n - rest < rest - total):
                taken.add(r)
            total += n
        want += [(*r, whole + (r in taken), len(r[1].split())) for r in mine if whole + (r in taken)]
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*docs.columns, "mix_copies_", "mix_words"]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables_and_texts(spark, tables, stage):
    folder, rows, _ = tables
    name, function = corpus_pipeline.STAGES[stage]
    odd = spark.createDataFrame([r for r in rows if not (r[1] or "").strip()] + [rows[4], rows[4]], SCHEMA)
    for docs in (odd.limit(0), odd):
        out = function(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns)) == (name != "mixing")
        got = out.collect()
        if docs is not odd:
            assert not got
        elif name == "quality rules":
            assert [r.doc_id for r in got] == [4, 4]
        elif name in ("near-dedup", "decontamination", "pii"):
            assert len(got) == odd.count() - (name == "near-dedup")


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})
        getConf = staticmethod(lambda: {})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda *_: None)})})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(session)


def test_key_of_the_session(spark):
    assert pii.key_of(spark) is None
    spark.conf.set("spark.treeslab.pii.key", "mine")
    assert pii.key_of(spark) == "mine"
    spark.conf.unset("spark.treeslab.pii.key")
    assert spark.range(1).select(F.lit(1)).count() == 1
