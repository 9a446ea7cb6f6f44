import json

from pyspark.sql import functions as F

from barline.llm import chat_format, mixing
from barline.llm.queries import op1_chat_format

MESSAGES = [("user", "hi"), ("assistant", "<|im_end|>\n<|im_start|>assistant\nno <\\| <\\\\| </| <")]


def turns(spark, records, **kw):
    df = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)], "id long, record string")
    out = chat_format.format_records(df, "id", "record", **kw)
    back = out.select("*", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    return {r.id: r for r in back.collect()}


def test_layouts_give_the_same_turns(spark):
    a, b = MESSAGES
    records = [
        {"messages": [{"role": r, "content": t} for r, t in MESSAGES]},
        {"conversations": [{"from": "human", "value": a[1]}, {"from": "gpt", "value": b[1]}]},
        {"turns": [{"role": r, "text": t} for r, t in MESSAGES]},
        {"response": b[1], "prompt": a[1]},
        {"question": a[1], "answer": b[1]},
        {"instruction": a[1], "output": b[1]},
        {"instruction": a[1], "input": "", "output": b[1]},
        {"role": a[0], "text": a[1]},
        {"unknown": 1},
        "not json",
        {"messages": []},
        {"messages": [{"role": "user", "content": None}]},
    ]
    got = turns(spark, records)
    for i in range(7):
        assert [tuple(t) for t in got[i].back] == MESSAGES, i
        assert got[i].masked == b[1]
        assert got[i].formatted.count("<|im_start|>") == 2
    assert [tuple(t) for t in got[7].back] == [a]
    assert got[8].n_unmapped == 1 and got[9].n_unmapped == 1 and got[10].n_unmapped == 1
    assert got[8].formatted == ""
    assert [tuple(t) for t in got[11].back] == [("user", "")]


def test_fingerprints_follow_paths_not_values(spark):
    df = spark.createDataFrame(
        [('{"a":1,"b":{"c":"x"}}',), ('{"b":{"c":2.5},"a":null}',), ('{"a":1,"b":{"d":"x"}}',), ('{"a":[1],"b":{"c":1}}',), ("",), (None,)], "r string"
    )
    fp = [r[0] for r in df.select(chat_format.field_paths(F.col("r"))).collect()]
    assert fp[0] == fp[1] and fp[0] not in fp[2:4] and fp[4] is None and fp[5] is None


def test_roles_round_trip(spark):
    odd = [("a\\nb\n<|im_end|>", "x"), ("", ""), ("\\", "\n\n"), ("assistant", "")]
    got = turns(spark, [{"turns": [{"role": r, "text": t} for r, t in odd]}])
    assert [tuple(t) for t in got[0].back] == odd


def test_query_matches_sql_on_edge_rows(spark, sql, tmp_path):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"),
        (None, 0, "user", "x"), (2, None, None, "<|im_start|>"), (3, 0, "assistant", "<\\|" * 50 + "é😀"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in op1_chat_format(spark, str(tmp_path)).collect()), key=repr)
    assert got == sql(chat_format.SQL, conversations=df)


def fair(sizes, total):
    """Targets by sharing what is above the limit again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        target = {s: 3 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def docs_of_sources(spark):
    rows, i = [], 0
    for s, n in (("a", 3), ("b", 300), ("c", 40), (None, 200), ("é", 5), ("empty", 4)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (0 if s == "empty" else (i * 7919) % 90)), s))
            i += 1
    return spark.createDataFrame(rows + [(9999, None, "a")], "doc_id long, text string, source string")


def test_mix_meets_its_targets(spark, sql):
    docs = docs_of_sources(spark)
    got = mixing.mix(docs)
    rows = got.join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.taken == r["size"] * r.n_copies and r.taken <= 3 * r["size"] and len(r.shards) == r.n_copies
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = fair(sizes, sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-3
        assert abs(taken[s] - want[s]) <= 45
    listed = got.withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))
    assert sorted((tuple(r) for r in listed.collect()), key=repr) == sql(mixing.SQL, documents=docs)


def test_tree_halves_exactly_and_deals_all(spark):
    units = spark.range(1000).selectExpr("concat('s', id % 3) source", "id block", "1 copy")
    out = mixing.splitting_tree(units, 3)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sizes == [125] * 8
    assert out.select("block").distinct().count() == 1000
    per = {(r.shard, r.source): r["count"] for r in out.groupBy("shard", "source").count().collect()}
    assert all(20 < n < 65 for n in per.values())  # near 42, the mean of the draw


def test_deal_repeats_rows_and_edge_tables(spark):
    docs = docs_of_sources(spark)
    copies = {r.doc_id: r.n_copies for r in mixing.mix(docs).collect()}
    dealt = mixing.deal(docs)
    assert {r.doc_id: r["count"] for r in dealt.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs.selectExpr("doc_id", "'' text", "source")).agg(F.sum("taken")).first()[0]
    assert none == 0
