"""Corpus operators against brute force, exact round trips and public encoders."""

import base64
import random
from bisect import bisect_left, insort

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.llm import dedupe, mixing, stuffing, tokens
from swathline.session import scratch_path

# --- batches against history --------------------------------------------------------------------------------


def _greedy(rows):
    kept, out = {}, {}
    for k0, k1, t, w, i, _ in sorted(rows, key=lambda r: (r[4], r[2])):
        have = kept.setdefault((k0, k1), [])
        j = bisect_left(have, t)
        out[i] = not ((j < len(have) and have[j] - t < w) or (j and t - have[j - 1] < w))
        if out[i]:
            insort(have, t)
    return out


def _batches(n=600, span=3_000, w=100):
    rng = random.Random(2)
    rows = [(1, rng.choice([1, 1, 1, 2, 3]), rng.randrange(-span, span), w, i, i // 100) for i in range(n)]
    rows += [(1, 1, 50, w, n + i, n // 100) for i in range(150)]
    rows += [(2, 9, i * 60, w, n + 200 + i, n // 100) for i in range(150)]
    rows += [(3, 1, 5, 0, n + 500, 7), (3, 1, 5, 0, n + 501, 7)]
    return rows


_SCHEMA = "k0 int, k1 bigint, t bigint, w bigint, id bigint, batch int"


@pytest.mark.parametrize("options", [{}, {"fanout": 2}, {"batches_per_round": 3, "max_group_rows": 40, "chunk_rows": 30}])
def test_dedupe_brute_force(spark, options):
    rows = _batches()
    exp = _greedy(rows)
    df = spark.createDataFrame([*rows, (None, 1, 1, 100, 9000, 1), (1, None, 1, 100, 9001, 1), (1, 1, None, 100, 9002, 1)], _SCHEMA)
    got = {r["id"]: r["accepted"] for r in dedupe.dedupe_batches(df, "batch", scratch_path(spark, "acc"), slot_s=1, **options).collect()}
    assert got == exp


def test_store_survives_and_conflicts(spark):
    root = scratch_path(spark, "acc")
    df = spark.createDataFrame(_batches(100), _SCHEMA)
    a, stale = dedupe.BatchStore(spark, root), dedupe.BatchStore(spark, root)
    a.accept(df)
    again = dedupe.BatchStore(spark, root).accept(df.withColumn("id", F.col("id") + 100_000).where("w > 0"))
    assert again.where("accepted").count() == 0
    with pytest.raises(Exception):
        stale.accept(df.where("k1 = 3"))
    third = dedupe.BatchStore(spark, root).accept(df.withColumn("id", F.col("id") + 200_000).where("w > 0"))
    assert third.where("accepted").count() == 0, "the losing writer has changed nothing"
    assert dedupe.dedupe_batches(df.where("false"), "batch", scratch_path(spark, "acc")).count() == 0


# --- tokens -------------------------------------------------------------------------------------------------

_HARD = ["", " ", "a", "it's we'LL", "  x\n\n\t y ", "aaaaaaa" * 60, "=-" * 300, "<|endoftext|>", "\x1c\x85　 z", "日本語 テキスト", "🤷🏽‍♀️🤷", "é́", "x" * 5000, "1234567890" * 30]


def _reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n=200):
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(0x80, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)]))
    return ["".join(pick() for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def test_tokens_exact(spark):
    texts = [*_HARD, *_random_texts(), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    enc = _reference()
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(df, ["doc_id"], "text").collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.where("false"), ["doc_id"], "text").count() == 0


def test_tokens_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_WORDS", 7)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    bpe, enc = tokens.Bpe(tokens.VOCABULARY), _reference()
    texts = [*_HARD, "one two three four five six seven eight nine ten " * 5]
    out = [[] for _ in texts]
    for k, ids in bpe.encode_slices(texts):
        out[k] += ids.tolist()
    assert out == [enc.encode_ordinary(t) for t in texts]


# --- mixing -------------------------------------------------------------------------------------------------


def test_fit_exact():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randrange(1, 200): rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))}
        whole = sum(k * c for k, c in counts.items())
        budget = rng.randrange(0, whole + 20)
        take, got = mixing.fit(counts, budget)
        assert all(0 < c <= counts[k] for k, c in take.items()) and got == sum(k * c for k, c in take.items())
        can = {0}
        for k, c in counts.items():
            can = {s + k * j for s in can for j in range(c + 1) if s + k * j <= budget + 200} if whole < 4000 else can
        if whole < 4000:
            assert abs(got - budget) == min(abs(s - budget) for s in can | {whole})


def _corpus(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "unlisted"]), rng.randrange(0, 60)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").persist()
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    return rows, docs, targets


@pytest.mark.parametrize("part_rows", [50_000, 3])
def test_mix_shares(spark, part_rows):
    rows, docs, targets = _corpus(spark)
    used, plans = mixing.mix(docs, "doc_id", "source", "n_tokens", targets, part_rows=part_rows)
    got = used.collect()
    caps = {"a": 1, "b": 2, "c": 3}
    size = {i: (s, n) for i, s, n in rows}
    assert len({r["doc_id"] for r in got}) == len(got)
    assert all(size[r["doc_id"]] == (r["source"], r["n_tokens"]) and 1 <= r["uses"] <= caps[r["source"]] and r["n_tokens"] > 0 for r in got)
    for p in plans:
        assert p.tokens == sum(r["uses"] * r["n_tokens"] for r in got if r["source"] == p.source)
        assert abs(p.tokens - p.budget) <= 1
    share = {r["source"]: r["actual_share"] for r in mixing.report(used, targets).collect()}
    for s, t in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9), ("none", 0)):
        assert share[s] == pytest.approx(t, abs=1e-3)


def test_mix_edges(spark):
    _, docs, targets = _corpus(spark)
    big, plans = mixing.mix(docs, "doc_id", "source", "n_tokens", targets, total=10**9)
    assert all(p.passes == p.repeats and not p.extra for p in plans) and big.count() > 0
    none, plans = mixing.mix(docs.where("false"), "doc_id", "source", "n_tokens", targets)
    assert none.count() == 0 and plans == []
    assert mixing.report(none, targets).count() == 4
    same = [sorted(map(tuple, mixing.mix(docs, "doc_id", "source", "n_tokens", targets)[0].collect())) for _ in range(2)]
    assert same[0] == same[1]


def test_one_batch_a_round(spark):
    root = scratch_path(spark, "rounds")
    df = spark.createDataFrame([(1, 1, 1_000 * b, 10, b, b) for b in range(3)], _SCHEMA)
    assert dedupe.dedupe_batches(df, "batch", root).where("accepted").count() == 3
    store = dedupe.BatchStore(spark, root)
    assert store.version == len(store.runs) == 3


def test_lookup_reads_no_history_of_other_zones(spark, monkeypatch):
    """Of a long history a batch reads the row groups its positives lie in, and the filters let few others pass."""
    monkeypatch.setattr(dedupe, "ROW_GROUP", 1 << 15)
    day = 86_400_000_000
    df = spark.range(400_000).select(F.lit(1).alias("k0"), (F.col("id") % 20_000).alias("k1"), (F.col("id") / 20_000).cast("bigint").alias("t"), F.lit(600_000_000).alias("w"), "id")
    df = df.withColumn("t", F.col("t") * (day // 2))
    store = dedupe.BatchStore(spark, scratch_path(spark, "long"))
    assert store.accept(df).where("accepted").count() == 400_000
    late = df.where("id IN (7, 20011, 390000)").withColumn("id", F.col("id") + 1_000_000)
    new = spark.range(1000).select(F.lit(1).alias("k0"), (F.col("id") + 50_000).alias("k1"), (F.lit(3) * day).alias("t"), F.lit(600_000_000).alias("w"), (F.col("id") + 2_000_000).alias("id"))
    batch = late.unionByName(new).select(*[F.col(c).cast("bigint").alias(c) for c in ("k0", "k1", "t", "w", "id")])
    found = store.history(batch)
    assert {r["id"] for r in found.collect()} >= {7, 20011, 390000} and found.count() < 60
    read = store._read("store", dedupe._STORED).where(store._zones(store._held))
    seen = spark._jsparkSession.sessionState().executePlan(read.select("fp")._jdf.queryExecution().logical(), spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.ALL()).executedPlan()
    scan = seen.collectLeaves().head()
    seen.executeCollect()
    assert scan.metrics().apply("numOutputRows").value() < 40_000
    decided = store.accept(batch)
    assert {r["id"] for r in decided.where("NOT accepted").collect()} == {1_000_007, 1_020_011, 1_390_000}


def test_history_is_not_shuffled(spark, monkeypatch):
    """However many positives a batch has, only the history rows that they match are moved."""
    monkeypatch.setattr(dedupe, "MAX_ZONES", 100)
    rows = lambda n, k, i: spark.range(n).select(F.lit(1).alias("k0"), (F.col("id") + k).alias("k1"), (F.col("id") * 1_000_000 + i % 7).alias("t"), F.lit(600_000_000).alias("w"), (F.col("id") + i).alias("id")).select(*[F.col(c).cast("bigint").alias(c) for c in dedupe._ROW])
    store = dedupe.BatchStore(spark, scratch_path(spark, "still"))
    assert store.accept(rows(300_000, 0, 0)).where("accepted").count() == 300_000
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = store.history(rows(20_000, 0, 1_000_000).unionByName(rows(20_000, 900_000, 2_000_000)))
        stages = spark.sparkContext._jsc.sc().statusStore()
        jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        done = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(stages.stageList(None, False, False, none, jvm.java.util.ArrayList()))}
        before = done()
        ids = {r["id"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert ids >= set(range(20_000)) and len(ids) < 25_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(n for s, n in done().items() if s not in before) < 100_000
    store._held.unpersist()


@pytest.mark.parametrize("batches_per_round", [1, 2])
def test_rows_without_batch(spark, batches_per_round):
    rows = [(*r[:5], None if r[4] % 7 == 0 else r[5]) for r in _batches(200) if r[4] < 350]
    for part in (rows, [(*r[:5], None) for r in rows]):
        got = dedupe.dedupe_batches(spark.createDataFrame(part, _SCHEMA), "batch", scratch_path(spark, "acc"), batches_per_round)
        assert {r["id"]: r["accepted"] for r in got.collect()} == _greedy(part)


# --- stuffed pages ------------------------------------------------------------------------------------------

_TALK = "I would rather not move the whole table again, since that takes an hour. Have a look at the option for it; it is off by default. "
_BAD = {
    1: "cheap lamp, buy lamp, lamp sale, buy, lamp, cheap, sale, lamp, buy, cheap lamp, sale",
    2: "\n".join(f"[cheap lamp](http://a{i}.example/x)" for i in range(6)),
    3: "\n".join(f"https://a{i}.example/x?id={i}" for i in range(6)),
    4: " ".join(f"#{w}{i}" for i, w in enumerate(["sale", "buy", "lamp", "cheap"] * 4)),
    5: "Looking for desk lamp? desk lamp here, desk lamp there! The best desk lamp, desk lamp reviews, desk lamp deals. Why desk lamp? Because desk lamp beats any other desk lamp.",
    6: "\n".join(f"lamp set AB-{i} 1{i}.95" for i in range(8)),
    7: _TALK + " | ".join(["buy", "lamp", "sale", "cheap"] * 12),
    8: "LAMP!!! http://a.example/1 sale BUY!!! cheap http://a.example/2 lamp SALE!!! http://a.example/3 cheap buy LAMP!!!",
}
_GOOD = {
    20: _TALK, 21: None, 22: "", 23: " 　 ", 24: "Upgrade.", 25: "See https://a.example/x for the dough.", 26: "https://a.example/only",
    27: "\n".join(f"* [one](http://a{i}.example/x): That happens because the sign is flipped in the south." for i in range(6)),
    28: "```python\n" + "x = lamp\n" * 40 + "```\nThat is all I have.", 29: "| lamp | sale |\n|---|---|\n| 1 | 2 |\n" * 6 + "These are the numbers I got.",
    30: "01:02:03 WARN lamp sale failed\n" * 20, 31: "My list of what went into it:\n- 5 x lamp (12 V)\n* 3 spare hinge\n- 4 x pump\n" + _TALK,
    32: "先に設定を読み込む必要があります。リンク https://a.example/x は切れています。同じ問題が2885回起きました。",
    33: _TALK * 3000,
}


def test_stuffed_pages(spark):
    rows = [(i, t, f"site{i % 3}" if i % 5 else None, 1) for i, t in {**_BAD, **_GOOD}.items()] + [(1, _BAD[1], "site1", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, total int")
    got = [r["doc_id"] for r in stuffing.stuffed_pages(df, "doc_id", "text", "source").collect()]
    assert sorted(got) == sorted([*_BAD, 1])
    assert stuffing.stuffed_pages(df.where("false"), "doc_id", "text", "source").count() == 0


def test_replication_decides(spark):
    """Keywords said once count only if another host says them too."""
    text = "lamp hinge valve pump screw tripod kettle saddle ladder bucket"
    one = spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string")
    two = one.unionByName(spark.createDataFrame([(2, text + " shovel", "b")], one.schema))
    ids = lambda d: sorted(r["doc_id"] for r in stuffing.stuffed_pages(d, "doc_id", "text", "source").collect())
    assert ids(one) == [] and ids(two) == [1, 2]


def test_all_selling_phrases():
    """Three mentions are enough, and every phrase of a page is tried."""
    reader = stuffing.Reader()
    share = lambda text: (lambda r: r[1] / r[0])(reader.read(text))
    assert share("Looking for desk lamp? The desk lamp for all, and desk lamp it is.") > 0.5
    goods = ["desk lamp", "hair clip", "knife set", "roof rack", "dog bed"]
    page = "\n\n".join(f"The {g} is what you want, {g} for you. It is a {g}, so {g} it is, and {g} again." for g in goods)
    assert share(page) > 0.5


def test_phrases_decide(spark):
    """Keywords said once need phrases, not words, of another host; sentence-like keywords count by held phrases."""
    schema = "doc_id bigint, text string, source string"
    ids = lambda rows: sorted(r["doc_id"] for r in stuffing.stuffed_pages(spark.createDataFrame(rows, schema), "doc_id", "text", "source").collect())
    text = "lamp hinge valve pump screw tripod kettle saddle ladder bucket"
    assert ids([(1, text, "a"), (2, " ".join(sorted(text.split())), "b")]) == []
    assert ids([(1, text, "a"), (2, f"shovel {text}", "b")]) == [1, 2]
    # "pas", "trop" and "en" are function words: every line reads as a sentence.
    told = "pas cher capteur trop lent vide\nen double capteur pas cher four\ntrop lent four en double vide\n" * 3
    goods = "lampe, montre, pas cher, capteur, parfum, lampe, trop lent, vide, canapé, montre, parfum, en double, four, canapé, lampe, montre"
    assert ids([(1, told, "c")]) == [] and ids([(1, told, "c"), (8, goods, "a"), (9, goods, "b")]) == [1, 8, 9]


def test_every_window(spark):
    """Phrases go on across the lines of a list, and selling phrases may have any length."""
    schema = "doc_id bigint, text string, source string"
    ids = lambda rows: sorted(r["doc_id"] for r in stuffing.stuffed_pages(spark.createDataFrame(rows, schema), "doc_id", "text", "source").collect())
    lines = "lamp\nhinge\nvalve\npump\nscrew\ntripod\nkettle\nsaddle\nladder\nbucket"
    assert ids([(1, lines, "a")]) == [] and ids([(1, lines, "a"), (2, "shovel\n" + lines, "b")]) == [1, 2]
    assert ids([(1, lines, "a"), (2, "\n".join(sorted(lines.split())), "b")]) == []
    goods = "solid oak folding garden dining table"
    text = f"If you want it now, here is the {goods} for you and for all of us. This is where we have the {goods} that you and i need. So why not get the {goods} while it is here?"
    assert ids([(1, text, "a")]) == [1]


def test_long_repeats():
    """Long runs of one word or of one passage take no longer than their length allows."""
    reader = stuffing.Reader()
    assert reader.read("lamp " * 20_000)[1] == 20_000
    passage = " ".join(f"ware{i}" for i in range(300))
    assert reader.read("\n".join([passage] * 4))[1] == 1200


def test_greedy_arrays():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 30)
        t = np.sort(np.array([rng.randrange(0, 60) for _ in range(n)], np.int64))
        order = np.array(rng.sample(range(100), n), np.int64)
        got = dedupe.greedy(np.zeros(n, np.int64), t, np.full(n, 7), order, np.zeros(n, bool))
        exp = _greedy([(0, 0, int(x), 7, int(o), 0) for x, o in zip(t, order, strict=True)])
        assert [exp[int(o)] for o in order] == got.tolist()
