"""The operators on DataFrames against plain versions, with nulls, repeats, clashing names and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bpe, chat, components, html_text, langid, media, mixing, pii, quality, rabitq, registry, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, 0.5) for i, t, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta.", "theta"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(0, 60)), f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s0"), (102, "  \n", "s1"), (None, text(5), "s1"), (103, text(40_000), "s0"), (104, "x" * 300_000, "s2")]
    rows += [rows[5], rows[5], (105, rows[6][1], "s0"), (106, rows[6][1] + " omega", None)]
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_per_document_operators_keep_every_row(spark, some, empty):
    df = docs(spark, some)
    for f in (bpe.encode_digests, bpe.encode_documents):
        got = f(df, bpe.default_vocabulary())
        assert got.count() == len(some) and f(empty, bpe.default_vocabulary()).count() == 0
    got = {(r["doc_id"], r["decoded"]) for r in bpe.encode_documents(df, bpe.default_vocabulary()).collect()}
    assert got == {(i, t or "") for i, t, _ in some}
    for f in (media.store, media.store_digests, pii.find, pii.redacted):
        assert f(df).count() == len(some) and f(empty).count() == 0
    for r in media.store_digests(df).collect():
        text = next((t or "") for i, t, _ in some if i == r["doc_id"])
        payload = media.payload_of(text)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = media.store(df).where("doc_id = 101").first()
    assert stored["samples"] == 1152 and stored["sample_rate"] == 32_000 and len(stored["seek_offsets"]) == 1
    text = {r["doc_id"]: r["redacted"] for r in pii.redacted(docs(spark, [(1, "to a.b@c.org now", "s"), (2, None, "s")])).collect()}
    assert text == {1: "to [EMAIL] now", 2: None}


def test_quality_query(spark, some, empty):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "four"]) + ("$$$" if i % 2 else "") for _ in range(30)), "s") for i in range(200)]
    df = docs(spark, rows + some[-12:])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)] + [(999, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    sample = quality.sample(df, labels, F.col("doc_id") >= 0, sample_rows=100)
    assert len(sample) == 100 and len(quality.sample(df, labels.limit(0), F.lit(True))) == 0
    model = quality.fit(sample)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) + 12 and all(0 <= g["score"] <= 1 for g in got)
    assert all((g["score"] >= 0.3) == (g["doc_id"] % 2 == 0) for g in got if g["doc_id"] is not None and g["doc_id"] < 60 and g["doc_id"] not in {i for i, _, _ in some[-12:]})
    assert quality.score(empty, model).count() == 0


def test_language_query(spark, some, empty):
    df = docs(spark, some).withColumn("lang", F.when(F.col("source") == "s0", "aa").when(F.col("source") == "s1", "bb"))
    sample = langid.sample(df, F.lit(True), "doc_id", "text", "lang", per_language=4)
    assert 0 < len(sample) <= 8 and {lang for lang, _ in sample} <= {"aa", "bb"}
    got = langid.identify(df, langid.fit(sample)).collect()
    assert len(got) == len(some) and {g["lang_pred"] for g in got} <= {"aa", "bb", "und"}
    assert all((g["lang_pred"] == "und") == (not any(c.isalpha() for c in (next(t for i, t, _ in some if i == g["doc_id"]) or ""))) for g in got)
    assert langid.identify(empty, langid.fit([])).count() == 0 and langid.sample(empty, F.lit(True), "doc_id", "text", "lang") == []


def test_html_query(spark):
    page = "<body><nav><a href=x>m</a></nav><article><p>A sentence of the text.</p></article></body>"
    df = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, "x"), (1, "u", page, "clash")], "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect())
    assert got == [(1, "A sentence of the text.", 23), (1, "A sentence of the text.", 23), (2, "", 0)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "b<|im_end|>"), (3, None, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int").repartition(3)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.formatted_records(chat.mixed_records(df))).collect()}
    one = "user\n\nassistant\nb<|im_end|>\nassistant\nb<|im_end|>\n"
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"]) == (3, hashlib.sha256(one.encode()).hexdigest(), 22)
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b<|im_end|>b<|im_end|>").hexdigest()
    assert set(got) == {1, 2, 3, None} and got[2]["loss_chars"] == 0
    assert chat.conversation_digests(chat.formatted_records(chat.mixed_records(df.limit(0)))).count() == 0
    records = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}'), (2, "[]"), (3, None), (4, '{"z": 1}')], "id int, record string")
    turns = sorted(((r["id"], r["layout"], r["item"], r["role"], r["text"]) for r in chat.canonical_turns(records, "id", "record").collect()), key=str)
    assert turns == [(1, "prompt_completion", 0, "user", "a"), (1, "prompt_completion", 1, "assistant", "b"), (2, None, None, None, None), (3, None, None, None, None), (4, None, None, None, None)]


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)] + [(7, 7), (1, 0), (1, 0)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = sorted({x for e in edges for x in e})
    pairs = {frozenset(e) for e in edges}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: c for n, c in want.items() if any(n in e and len(e) > 1 for e in pairs)}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_simhash_query(spark, some, empty, bucket_rows):
    r = random.Random(4)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(400)).split()
    near = []
    for i in range(60):
        words = base.copy()
        for _ in range(r.randrange(4)):
            words[r.randrange(400)] = "changed"
        near.append((1000 + i, " ".join(words), "s"))
    rows = some + near
    got = simhash.near_duplicates(docs(spark, rows), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    prints = {(i, t): simhash.fingerprint(t) for i, t, _ in rows}
    values = sorted(set(prints.values()))
    group = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for (i, _), fp in prints.items():
        if i is not None:
            low[group[fp]] = min(low.get(group[fp], i), i)
    want = sorted(((i if i is not None else -1), fp, low.get(group[fp])) for (i, t, _) in rows for fp in [prints[i, t]])
    assert sorted((g["doc_id"] if g["doc_id"] is not None else -1, g["fp"] & (1 << 64) - 1, g["component_id"]) for g in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("direct_rows", "bucket_rows", "block_rows"), [(2048, 4096, 1024), (16, 4096, 1024), (16, 8, 1024), (2048, 8, 5)])
def test_vector_query(spark, direct_rows, bucket_rows, block_rows):
    r = np.random.default_rng(5)
    base = r.standard_normal((90, 16))
    vectors = [*base, *(base[:30] + 0.03 * r.standard_normal((30, 16))), *(base[:3] * 5), *[base[7]] * 20, *(base[9] + 0.04 * r.standard_normal((25, 16)))]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3 == 0)) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [0.0] * 15, 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (None, rows[1][1], rows[1][2]), (907, [], 1)]
    df = spark.createDataFrame([(*x, 3) for x in rows + odd], "vec_id bigint, embedding array<float>, label int, copies int").repartition(3)
    got = {g["vec_id"]: g for g in rabitq.near_duplicate_vectors(df, direct_rows=direct_rows, bucket_rows=bucket_rows, block_rows=block_rows).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    near = lambda a, b: label[a] == label[b] and float(unit[a] @ unit[b]) >= 0.98
    want = plain_components(sorted(unit), near)
    for i in unit:
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
        assert got[i]["n_links"] == sum(near(i, j) for j in unit if j != i)
    for i in (900, 901, 902, 903, 904, 905, 906, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert rabitq.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 2.4])
def test_vector_recall_in_a_large_label(spark, shift):
    """50,000 vectors of 64 dimensions in one label, around one direction (median cosine 0.85) or none, with pairs around the threshold, against all pairs in double precision."""
    r = np.random.default_rng(15)
    base = r.standard_normal((44_000, 64)) + shift
    step = r.uniform(0.05, 0.25, (6000, 1)) * math.hypot(1, shift) * r.standard_normal((6000, 64))
    x = np.concatenate([base, base[:6000] + step]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>").selectExpr("*", "1 as label").repartition(8)
    got = {g["vec_id"]: g["n_links"] for g in rabitq.near_duplicate_vectors(df).select("vec_id", "n_links").collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(len(x), int)
    for a in range(0, len(x), 2000):
        want[a : a + 2000] = (unit[a : a + 2000] @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 3000 and [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_mixing_query(spark, some, empty, group_rows):
    df = docs(spark, some)
    got = mixing.mix(df, group_rows=group_rows).collect()
    again = mixing.mix(df.repartition(2), group_rows=group_rows).collect()
    key = lambda g: str((g["doc_id"], g["size"], g["times"]))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(some)
    sizes, total = {}, 0
    for _, t, s in some:
        n = len((t or "").encode().split())
        sizes[s] = sizes.get(s, 0) + n
        total += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    by_id = {i: s for i, _, s in some}
    taken = {s: 0 for s in order}
    for g in got:
        s = by_id[g["doc_id"]]
        assert math.isclose(g["target"], target[s], rel_tol=1e-9) and g["source_size"] == sizes[s] and 0 <= g["times"] <= 3
        assert g["times"] in (math.floor(target[s] / max(1, sizes[s]) + 1e-9), math.floor(target[s] / max(1, sizes[s]) + 1e-9) + 1)
        taken[s] += g["times"] * g["size"]
    largest = {s: max(len((t or "").encode().split()) for _, t, x in some if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(60, largest[s] / 2 + 60) for s in order)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    """Queries that SQL can express, against DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("embeddings", "conversations", "documents", "stamps"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_registered_queries(spark, sf_dir):
    """Every contract query runs over its whole table."""
    size = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("documents", "embeddings", "pages", "stamps")}
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    for name, f in registry.queries().items():
        want = {"op4_rabitq": size["embeddings"], "op8_html": size["pages"], "op6_chat": convs + 1, "op11_repair": convs, "op13_stamps": size["stamps"]}.get(name, size["documents"])
        assert f(spark, sf_dir).count() == want, name


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def alike(a, b):
    """Similarity of 0.8 or more, in whole numbers."""
    return not a and not b or 10 * len(a & b) >= 8 * len(a | b) > 0


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version of its decision; near copies by similarity 0.8 of five-word shingles, as the stage's contract has it."""
    import corpus_pipeline as p

    columns = list(p.COLUMNS)
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    good = start.where("length(text) > 300").first()["text"]
    extra = [(None, "only words without id here now", None, None, None), (77_777, None, "en", None, None), (start.first()["doc_id"], good + " another text under a known id", "en", "s", 1), (88_888, "word " * 200_000, "en", None, 5)]
    cards = [next(f"{d}23456789012345{c}" for c in "0123456789" if pii.luhn(f"{d}23456789012345{c}")) for d in "0123456789"]
    extra.append((99_999, good + " cards: " + ", ".join(cards) + ".", "en", "s", 1))
    start = start.unionByName(start.limit(3)).unionByName(spark.createDataFrame(extra, start.schema))
    docs, results = start.withColumn("key", F.lit(1)).withColumn("copies", F.lit("clash")), []
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        results.append(docs.collect())
        docs = spark.createDataFrame(results[-1], start.schema).withColumn("key", F.lit(1)).withColumn("copies", F.lit("clash")).withColumn("score", F.lit(0))
    kept, single, clean, mixed = results
    sets = [plain_shingles(r["text"]) for r in kept]
    distinct = sorted(set(sets), key=sorted)
    group = plain_components(list(range(len(distinct))), lambda a, b: alike(distinct[a], distinct[b]))
    class_of = {s: group[k] for k, s in enumerate(distinct)}
    smallest = {}
    for r, s in zip(kept, sets, strict=True):
        if r["doc_id"] is not None:
            smallest[class_of[s]] = min(smallest.get(class_of[s], r["doc_id"]), r["doc_id"])
    left = [class_of[plain_shingles(r["text"])] for r in single]
    assert len(left) == len(set(left)) == len(set(class_of.values()))
    assert all(r["doc_id"] in (None, smallest.get(c)) for r, c in zip(single, left, strict=True))
    assert len(clean) == len(single) and all(not pii.base_spans(r["text"] or "") for r in clean)
    before = {(r["doc_id"], r["source"]): r["text"] for r in single}
    assert all(r["text"] == before[r["doc_id"], r["source"]] for r in clean if not pii.base_spans(before[r["doc_id"], r["source"]] or "") and "[" not in (r["text"] or ""))
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in clean}
    coded = p.encode(spark, docs, sf_dir).collect()
    assert len(coded) == len(mixed) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in coded)
    assert p.run(spark, sf_dir).count() > 0


def test_pipeline_stages_take_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, copies int, times int")
    for name, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_mixing_stage_repeats_rows_as_often_as_they_are_taken(spark, sf_dir):
    import corpus_pipeline as p

    rows = [(1, "a b c", "en", "s", 5)] * 4 + [(1, "d e", "en", "s", 3), (None, "f", "en", None, 1), (None, "f", "en", None, 1), (2, "g " * 9, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    keyed = docs.withColumn("k", F.concat_ws("|", "doc_id", "text", "source"))
    want = {r["k"]: r["t"] for r in mixing.mix(keyed, id_col="k").groupBy("k").agg(F.sum("times").alias("t")).collect()}
    got = p.mix_sources(spark, docs, sf_dir)
    assert got.columns == list(p.COLUMNS) and sum(want.values()) == got.count()
    assert {r["text"] for r in got.collect()} <= {r[1] for r in rows}


def test_pipeline_removes_unredacted_rows(spark, sf_dir):
    """Once the pipeline has run, only the last stage's folder is left."""
    import os

    import corpus_pipeline as p

    p.run(spark, sf_dir).count()
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = {name for d, names, _ in os.walk(top) for name in names if name.startswith("stage")}
    assert left == {f"stage{len(p.STAGES) - 2}"}
