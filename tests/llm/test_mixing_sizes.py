"""The mix lands near its targets whatever the sizes of other sources and of single documents."""

import random

from quillmark.llm import mixing


def test_long_documents_beside_a_large_source(spark):
    r = random.Random(8)
    rows = []
    for s in range(30):
        source = "a" if s == 0 else f"b{s:02}"
        for k in range(600 if s == 0 else 40):
            rows.append((len(rows), "w " * (80 if k == 0 else r.randint(1, 20)), source))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, group_rows=64, weights=(1,)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for g in got:
        s = source[g["doc_id"]]
        taken[s], target[s] = taken.get(s, 0) + g["size"] * g["times"], g["target"]
    assert max(abs(taken[s] - target[s]) for s in target) <= 10


def test_large_groups_keep_their_ends_open():
    sizes = [float(1 + i * 7 % 40) for i in range(40)]
    p = mixing.fly_middle([0.4] * 40, sizes, mixing.np.random.default_rng(1), 2)
    ends = sorted(range(40), key=lambda i: sizes[i])
    assert all(p[i] == 0.4 for i in (*ends[:2], *ends[-2:])) and sum(0 < x < 1 for x in p) <= 6
    assert abs(sum(p) - 16) < 1e-6 and abs(sum(x * n for x, n in zip(p, sizes, strict=True)) - 0.4 * sum(sizes)) < 1e-6


def test_repeated_and_null_ids_are_split(spark):
    """Rows of one id, equal or not, are dealt to many groups, whatever the partitions, and reruns agree."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    rows = [(None, "w " * r.randint(1, 30), "a") for _ in range(1500)] + [(5, "x y z", "a")] * 1200 + [(i, "w " * r.randint(1, 9), "b") for i in range(300)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    narrow = df.repartition(6).select(F.col("doc_id").alias("id"), "source", mixing.size_of("text").alias("size"), F.xxhash64("text").alias("digest"), F.spark_partition_id().alias("part"))
    named = mixing.numbered(mixing.checkpointed(narrow), len(rows)).groupBy("id", "source", "digest").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("copy")).alias("copies")).collect()
    assert sum(g["n"] for g in named) == len(rows) and all(g["copies"] == list(range(g["n"])) for g in named)
    outcomes = []
    for k in (2, 7):
        got = mixing.mix(df.repartition(k), group_rows=64).collect()
        outcomes.append(sorted((str(g["doc_id"]), g["size"], g["times"]) for g in got))
        taken, target = {}, {}
        for g in got:
            key = g["source_size"]
            taken[key], target[key] = taken.get(key, 0) + g["size"] * g["times"], g["target"]
        assert len(got) == len(rows) and max(abs(taken[s] - target[s]) for s in target) <= 10
    assert outcomes[0] == outcomes[1]
