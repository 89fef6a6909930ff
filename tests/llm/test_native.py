"""URL filters and chat formatting: no Python runs on the workers."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treeslab.llm import chat, pii, urls
from treeslab.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


URLS = [
    "http://a.example.org/es/x", "https://EXAMPLE.org/en/1?x#y", "http://www.spam-farm.example.net/zz", "http://cheap-pills.example.com", "http://cheap-pills.example.com/fr/1",
    "http://x.com/de/", "http://com/de/2", "ftp://notorg/", "http://org", "http://b.org/", "no scheme", None, "", "://", "a://b://c.org/x", "http://example.org/en/2", "http://h.net?q=/fr/", "http://x.com#/de/", "http://evil-casino-win.example.com/q", "HTTP://CASINO-WIN.EXAMPLE.COM/a\nb",
]


def brute(url):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    listed = any(host == x or host.endswith("." + x) for x in urls.LISTED)
    return host, path, rule, verdict or ("block" if listed else "allow")


def test_urls(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS * 2)] + [(None, "http://b.org/", None, None)]
    listed = spark.createDataFrame([(x,) for x in urls.LISTED], "key string")
    out = urls.judge(frame(spark, rows), listed)
    got = sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out.collect())
    assert got == sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert urls.judge(frame(spark, []), listed).count() == 0
    assert {r.verdict for r in urls.judge(frame(spark, [(1, "http://a.b/", None, None)]), listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark, monkeypatch):
    """A tight first level errs; the others correct it. Also in shards."""
    monkeypatch.setattr(urls, "BITS_A_KEY", 3)
    monkeypatch.setattr(urls, "PROBES", 2)
    rng = random.Random(4)
    hosts = [f"h{k}.net" for k in range(1500)]
    listed = set(rng.sample(hosts, 300)) | {"not-there.net"}
    keys = spark.createDataFrame([(x,) for x in listed], "key string")
    universe = spark.createDataFrame([(x,) for x in hosts], "key string")
    levels = urls.cascade(keys, universe)
    assert len(levels) > 2
    held = {r.key for r in universe.where(urls.contains(levels, F.col("key"))).collect()}
    assert held == listed - {"not-there.net"}
    pages = frame(spark, [(k, f"http://{h}/x", None, None) for k, h in enumerate(hosts)])
    for size in (1000, 100):
        monkeypatch.setattr(urls, "SHARD_KEYS", size)
        blocked = {r.host for r in urls.judge(pages, keys).collect() if r.verdict == "block"}
        assert blocked == listed - {"not-there.net"}


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\s", "\\l<", "<turn user>", "</turn>\n", "a > b < c", "\\\\s\\", "<|image 1|>", "é\U0001f600</turn>", "\n\n", "x" * 3000]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None, "sys<>tem\\"]), rng.choice(nasty)) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, None, "assistant", "no id")]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, parts string, formatted int")
    turns = frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_turns(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in out:
        mine = sorted([(x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in mine]
        assert r.learned == "".join(x[3] for x in mine if x[2] == "assistant")
    assert len(out) == 21
    assert chat.digests(frame.limit(0)).count() == 0


def test_chat_parts(spark):
    part = "struct<type: string, text: string, ref: string, size: bigint>"
    rows = [(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 300000), None, ("audio", None, "b.wav", 50)]), (1, 1, "assistant", [("text", "ok", None, None), ("film", None, "c.mp4", 9)]), (2, 0, "user", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = {r.conv_id: r for r in chat.format_turns(frame).collect()}
    assert out[1].formatted == "<turn user>see \\l<|image 1|><|audio 2|></turn>\n<turn assistant>ok<|document 3|></turn>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for a in out[1].attachments] == [(1, "image", "a.png", 85 + 2 * 170), (2, "audio", "b.wav", 3), (3, "document", "c.mp4", 3)]
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss] == ["ok<|document 3|>"]
    assert out[2].formatted == "<turn user></turn>\n" and out[2].loss == [] and out[2].attachments == []


@pytest.mark.parametrize("name", ["op2_pii", "op5_url_filters", "op8_chat_formatting"])
def test_plans_hold_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["op5_url_filters", "op8_chat_formatting"])
def test_same_as_sql(spark, sf_dir, name):
    from treeslab.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).fetchdf()
    columns = sorted(got.columns)
    text = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert len(got) and text(got) == text(want)


def test_mask_has_no_shuffle(spark, sf_dir):
    plan = pii.mask(spark.read.parquet(f"{sf_dir}/documents.parquet"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
