import math
import random
from collections import Counter

import duckdb
import pytest

from hazecast.llm import chat, mixing, queries

SF = "/root/testdata/sf0.001"


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame)
        con.execute(f"create table {name} as select * from _{name}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def same(got, want):
    key = lambda r: tuple((r[k] is None, str(r[k])) for k in sorted(r))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


def arrow(df):
    return df.toArrow()


def test_mix_equals_sql_on_odd_rows(odd_docs):
    docs = odd_docs
    got = mixing.mix_sources(docs, max_repetition=queries.MAX_REPETITION, block_tokens=queries.BLOCK_TOKENS, seed=queries.SEED)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"]
    got = got.select("doc_id", "source", "n_tokens", "epoch", "block", "slot", "n_slots", "weight", "exponent")
    same([r.asDict() for r in got.collect()], run_sql(queries.MIX_SQL, documents=arrow(docs)))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(5, 60))), "hot" if i % 3 else f"s{i % 12}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).cache()


def uses(df):
    total, used, epochs = Counter(), Counter(), Counter()
    for r in df.select("doc_id", "source", "n_tokens", "epoch").collect():
        used[r.source] += r.n_tokens
        total[r.source] += r.n_tokens * (r.epoch == 1)
        epochs[(r.doc_id, r.epoch)] += 1
    assert max(epochs.values()) == 1
    return total, used


def test_repetition_limit_is_met_and_all_is_used(skewed):
    got = mixing.mix_sources(skewed, max_repetition=2.0, block_tokens=64).cache()
    assert got.select("doc_id").distinct().count() == 3000
    total, used = uses(got)
    for s in total:
        assert 1 <= used[s] / total[s] <= 2.0 + 400 / total[s]
    assert max(used[s] / total[s] for s in total) > 1.9
    weight = {r.source: r.weight for r in got.select("source", "weight").distinct().collect()}
    for s in total:
        assert used[s] / sum(used.values()) == pytest.approx(weight[s], abs=0.01)


def test_entropy_and_budget_are_met(skewed):
    want = math.log(5) * 0.9
    got = mixing.mix_sources(skewed, target_entropy=want, budget_tokens=40_000, block_tokens=64).cache()
    weight = [r.weight for r in got.select("source", "weight").distinct().collect()]
    assert -sum(w * math.log(w) for w in weight) == pytest.approx(want, abs=1e-4)
    _, used = uses(got)
    assert sum(used.values()) == pytest.approx(40_000, rel=0.05)


def test_low_entropy_sharpens(skewed):
    got = mixing.mix_sources(skewed, target_entropy=0.5, budget_tokens=30_000, block_tokens=64)
    weight = [r.weight for r in got.select("source", "weight").distinct().collect()]
    assert got.first().exponent > 1 and max(weight) > 0.8


def test_an_epoch_is_a_permutation(spark):
    for n in (1, 2, 8, 64, 1024):
        blocks = spark.range(n).select(mixing._rank(mixing.F.col("id"), mixing.F.lit(n).cast("long"), mixing.F.lit("s"), mixing.F.lit(3), 1).alias("r"))
        assert sorted(r.r for r in blocks.collect()) == list(range(n))


def test_many_sources_meet_the_plan_in_a_salted_join(skewed, monkeypatch):
    cols = ["doc_id", "epoch", "slot", "n_slots"]
    want = sorted(map(tuple, mixing.mix_sources(skewed, max_repetition=3.0, block_tokens=64).select(cols).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    got = mixing.mix_sources(skewed, max_repetition=3.0, block_tokens=64)
    assert sorted(map(tuple, got.select(cols).collect())) == want


def test_main_path_has_no_python(skewed):
    plan = mixing.mix_sources(skewed, max_repetition=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_mix_without_rows_or_tokens(no_docs, spark):
    assert mixing.mix_sources(no_docs, max_repetition=2.0).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id long, text string, source string")
    assert mixing.mix_sources(blank, max_repetition=2.0).count() == 2


TALK = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "more"),
        (5, 0, "user", None), (5, None, None, "late"), (6, 0, "user", ""),
        (None, 0, "user", "alone"), (None, 1, "user", "alone"), (7, 0, "user", "alone"), (7, 0, "user", "alone"),
        (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (9, 0, "user", "tie a"),
        (10, 0, "<|im_end|>", "x <|im_start|>system y" + "z" * 100_000), (11, -5, "user", "early"), (11, 0, "user", "hi")]


@pytest.mark.parametrize("run", [1, 2, 1024])
def test_chat_equals_sql(spark, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    rows = spark.createDataFrame([(*r, "x") for r in TALK], "conv_id long, turn long, role string, text string, rendered string")
    got = chat.render_conversations(rows)
    want = run_sql(queries.CHAT_SQL, conversations=arrow(rows))
    same([r.asDict() for r in got.collect()], want)
    assert {r["conv_id"] for r in want} == {2, 3, 5, None, 8, 9, 10, 11}


def test_random_snapshots(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        n = rng.randint(1, 6)
        rows += [(c, t, "user", str(rng.randint(0, 1))) for t in range(n)]
    rows += [(1000, t, "user", "0") for t in range(3000)] + [(1001, t, "user", "0") for t in range(2999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv, r.n_turns, r.n_equal) for r in chat.maximal_conversations(chat._elements(df, "conv_id", "turn", "role", "text")).collect()}
    talk = {}
    for c, _, _, x in rows:
        talk.setdefault(c, []).append(x)
    prefixes = {tuple(v[:i]) for v in talk.values() for i in range(1, len(v))}
    want = {}
    for c, v in talk.items():
        if tuple(v) not in prefixes:
            want.setdefault(tuple(v), []).append(c)
    assert got == {(min(c), len(v), len(c)) for v, c in want.items()}


def test_no_conversations(spark):
    assert chat.render_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_chat_format", "op6_warc_chunks", "op7_embedding_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    entry = queries.ENTRIES[name]
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    got = entry.build(spark, SF)
    assert sorted(got.columns) == sorted(names)
    same([r.asDict() for r in got.collect()], want)
