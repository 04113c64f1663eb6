"""Joins between recognised facts, structured fields, regions and vocabularies; unions and coverage."""

from __future__ import annotations

import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import bound
from quillmark.functions import text as t


def known_regions(references: DataFrame, regions: DataFrame) -> DataFrame:
    """References (doc_id, region_id, ...) to regions that exist."""
    return references.join(regions.select("doc_id", "region_id"), ["doc_id", "region_id"], "left_semi")


def uncovered_regions(regions: DataFrame, *used: DataFrame) -> DataFrame:
    """Regions (doc_id, region_id) that none of the given references names."""
    named = used[0].select("doc_id", "region_id")
    for u in used[1:]:
        named = named.unionByName(u.select("doc_id", "region_id"))
    return regions.select("doc_id", "region_id").join(named, ["doc_id", "region_id"], "left_anti")


def coverage(regions: DataFrame, mapped: DataFrame, disposed: DataFrame) -> DataFrame:
    """(doc_id, regions, mapped, disposed, uncovered, ratio) over distinct regions; a mapped region isn't also disposed."""
    # one aggregation by region over the three tables: nothing is sorted or held for a join
    side = lambda df, name: df.select("doc_id", "region_id", *[F.lit(n == name).alias(n) for n in ("r", "m", "d")])
    every = side(regions, "r").unionByName(side(mapped, "m")).unionByName(side(disposed, "d"))
    flags = every.groupBy("doc_id", "region_id").agg(*[F.bool_or(n).alias(n) for n in ("r", "m", "d")]).where("r")
    rows = flags.select("doc_id", *[F.when(F.col(n), 1).alias(n) for n in ("m", "d")])
    per = rows.groupBy("doc_id").agg(
        F.count("*").alias("regions"), F.count("m").alias("mapped"), F.count_if(F.col("m").isNull() & F.col("d").isNotNull()).alias("disposed"),
        F.count_if(F.col("m").isNull() & F.col("d").isNull()).alias("uncovered"),
    )
    return per.withColumn("ratio", (F.col("regions") - F.col("uncovered")) / F.col("regions"))


def comparison_key(value: Column) -> Column:
    return F.regexp_replace(t.folded(value), " ", "")


def comparison_variants(value: Column) -> Column:
    """Keys under which a value may be found: itself and, for eight digits, both ways of writing the date. None if too short."""
    empty = F.array().cast("array<string>")

    def dated(digits):
        # the other way of writing a date is the same digits in another order; only plausible ones reach the calendar
        day, month, year = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])", "([0-9]{4})"
        turned = lambda d, s: F.when(d.isNotNull(), F.array(digits, s)).otherwise(empty)
        year_first = turned(F.try_to_date(digits, "yyyyMMdd"), F.concat(F.substr(digits, F.lit(7)), F.substr(digits, F.lit(5), F.lit(2)), F.left(digits, F.lit(4))))
        day_first = turned(F.try_to_date(digits, "ddMMyyyy"), F.concat(F.right(digits, F.lit(4)), F.substr(digits, F.lit(3), F.lit(2)), F.left(digits, F.lit(2))))
        return F.concat(
            F.when(digits.rlike(f"^{year}{month}{day}$"), year_first).otherwise(empty), F.when(digits.rlike(f"^{day}{month}{year}$"), day_first).otherwise(empty)
        )

    def variants(base):
        short = (F.length(base) < 4) | (base.rlike("^[0-9]+$") & (F.length(base) < 5))
        every = F.concat(F.array(base), bound(F.regexp_replace(value, r"\D", ""), dated))
        return F.when(short, empty).otherwise(F.array_distinct(F.array_compact(every)))

    return bound(comparison_key(value), variants)


def variants_meet(left: Column, right: Column) -> Column:
    """Whether one of some variants contains one of the others."""
    return F.exists(left, lambda x: F.exists(right, lambda y: y.contains(x) | x.contains(y)))


def values_match(left: Column, right: Column) -> Column:
    """Whether a variant of one value contains a variant of the other."""
    return bound(comparison_variants(right), lambda b: variants_meet(comparison_variants(left), b))


def field_consistency(fields: DataFrame, selectors: DataFrame, facts: DataFrame) -> DataFrame:
    """Structured fields against extracted facts.

    fields: doc_id, field, value. selectors: field, field_code, role (null: any). facts: doc_id, field_code, role, value. Per field:
    matched if any candidate matches, unmatched if exactly one candidate doesn't, else undecided. Equi join on the document and the
    code, the text comparison as a residual.
    """
    # variants are made once a value, before the join
    wanted = fields.withColumn("wanted", comparison_variants(F.col("value"))).join(selectors, "field")
    f = facts.withColumn("said", comparison_variants(F.col("value"))).withColumnRenamed("value", "fact").withColumnRenamed("role", "fact_role")
    pairs = wanted.join(f, ["doc_id", "field_code"], "left").where(F.col("role").isNull() | F.col("fact_role").isNull() | (F.col("role") == F.col("fact_role")))
    per = pairs.groupBy("doc_id", "field").agg(
        F.coalesce(F.bool_or(variants_meet(F.col("wanted"), F.col("said"))), F.lit(False)).alias("any_match"), F.count("fact").alias("candidates")
    )
    state = F.when(F.col("any_match"), "matched").when(F.col("candidates") == 1, "unmatched").otherwise("undecided")
    return per.select("doc_id", "field", "candidates", state.alias("state"))


def consistency_mismatch(compared: DataFrame) -> DataFrame:
    """(doc_id, matched, unmatched, mismatch): a mismatch needs two matched fields as witnesses."""
    per = compared.groupBy("doc_id").agg(F.count_if(F.col("state") == "matched").alias("matched"), F.count_if(F.col("state") == "unmatched").alias("unmatched"))
    return per.withColumn("mismatch", (F.col("matched") >= 2) & (F.col("unmatched") > 0))


def visible_fields(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, field, visible): whether a field's key occurs in the document's text.

    A document's wanted variants come to its text as one array, so the text is moved and folded once.
    """
    wanted = fields.select("doc_id", F.struct("field", comparison_variants(F.col("value")).alias("variants")).alias("f")).groupBy("doc_id").agg(F.collect_list("f").alias("fields"))
    rows = wanted.join(texts.select("doc_id", comparison_key(F.col("text")).alias("seen")), "doc_id", "left")
    found = rows.select("doc_id", "seen", F.explode("fields").alias("f"))
    # the fold is generated into a row before the fields are told apart, so that it runs once a text
    return found.select("doc_id", "f.field", F.coalesce(F.exists("f.variants", lambda v: F.col("seen").contains(v)), F.lit(False)).alias("visible"))


def name_variant(left: Column, right: Column) -> Column:
    """Whether two names differ by one inserted character: one key holds the other, of five characters at least.

    With the shorter key inside the longer one and a difference of one, the matching ratio 2n / (2n + 1) is at least 0.9 from five on.
    """
    a, b = comparison_key(left), comparison_key(right)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= 5) & (F.length(long) - F.length(short) == 1) & long.contains(short)


def name_classes(names: DataFrame, group: str, name: str, key: str) -> DataFrame:
    """(g, k, id, name, copies): a group's names by their key, each stood for by its row of the smallest id."""
    k = comparison_key(F.col(name))
    rows = names.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(name).alias("name"), k.alias("k")).where(F.length("k") >= 5)
    return rows.groupBy("g", "k").agg(F.min(F.struct("id", "name")).alias("first"), F.count("*").alias("copies")).select("g", "k", "first.id", "first.name", "copies")


def name_pairs(names: DataFrame, group: str, name: str, key: str) -> DataFrame:
    """(g, short_id, long_id, short_name, long_name, short_copies, long_copies): variant pairs of the name classes of a group.

    Instead of comparing all pairs, each key emits its two ends cut by one character, and pairs meet on those by an equi
    join: a key holds one that is shorter by one only if it starts or ends with it. Repeated names are one class.
    """
    classes = name_classes(names, group, name, key)
    cut = F.array_distinct(F.array(F.expr("left(k, length(k) - 1)"), F.expr("right(k, length(k) - 1)")))
    longer = classes.select("g", F.col("id").alias("long_id"), F.col("name").alias("long_name"), F.col("copies").alias("long_copies"), F.explode(cut).alias("k"))
    shorter = classes.select("g", F.col("id").alias("short_id"), F.col("name").alias("short_name"), F.col("copies").alias("short_copies"), "k")
    return shorter.join(longer, ["g", "k"]).select("g", "short_id", "long_id", "short_name", "long_name", "short_copies", "long_copies")


def one_digit_conflict(cards: DataFrame) -> DataFrame:
    """(doc_id, first, second) of documents with exactly two distinct card numbers of one length that differ in one place."""
    per = cards.groupBy("doc_id").agg(F.min("number").alias("first"), F.max("number").alias("second"), F.countDistinct("number").alias("n"))
    differing = F.aggregate(F.zip_with(F.split("first", ""), F.split("second", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    return per.where((F.col("n") == 2) & (F.length("first") == F.length("second"))).where(differing == 1).select("doc_id", "first", "second")


def sole_country(evidence: DataFrame) -> DataFrame:
    """(doc_id, country) of documents whose evidence names exactly one country."""
    per = evidence.groupBy("doc_id").agg(F.countDistinct("country").alias("n"), F.min("country").alias("country"))
    return per.where("n = 1").select("doc_id", "country")


def reviewed(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Facts with contradicted values replaced: (doc_id, fact_ix, value, status); of repeated reviews the first stays."""
    w = Window.partitionBy("doc_id", "fact_ix").orderBy("review_ix")
    r = reviews.where((F.col("verdict") == "contradicted") & F.col("correction").isNotNull()).withColumn("n", F.row_number().over(w)).where("n = 1")
    rows = facts.join(r.select("doc_id", "fact_ix", "correction"), ["doc_id", "fact_ix"], "left")
    return rows.select("doc_id", "fact_ix", F.coalesce("correction", "value").alias("value"), F.when(F.col("correction").isNotNull(), "corrected").otherwise("unchanged").alias("status"))


def replace_detector(findings: DataFrame, name: str, new: DataFrame) -> DataFrame:
    """Findings with those of one detector exchanged for new ones."""
    return findings.where(F.col("detector") != name).unionByName(new)


class _Places:
    """Places of a group's names by their key, to find the next one that a name can be a variant of."""

    def __init__(self, keys: list[str | None]):
        self.keys, self.at, self.longer = list(keys), defaultdict(list), defaultdict(set)
        for place, key in enumerate(keys):
            self.add(place, key)

    def add(self, place: int, key: str | None) -> None:
        if key:
            bisect.insort(self.at[key], place)
            self.longer[key[:-1]].add(key)
            self.longer[key[1:]].add(key)

    def give(self, place: int, key: str) -> None:
        """The name at a place takes over another key."""
        old = self.keys[place]
        self.at[old].pop(bisect.bisect_left(self.at[old], place))
        self.keys[place] = key
        self.add(place, key)

    def next(self, place: int, after: int) -> int | None:
        """The first place after one whose name is a variant of a place's name."""
        key, found = self.keys[place], None
        others = ([key[:-1], key[1:]] if len(key) > 5 else []) + (list(self.longer[key]) if len(key) >= 5 else [])
        for other in others:
            places = self.at.get(other, ())
            k = bisect.bisect_right(places, after)
            if k < len(places) and (found is None or places[k] < found):
                found = places[k]
        return found


def fold_names(keys: list[str | None]) -> list[int]:
    """For each name of a group, by its key, the place of the name that it ends up with: every pair in order, the longer of two variants taken over by both."""
    places, holds = _Places(keys), list(range(len(keys)))
    for i in range(len(keys)):
        j = i
        while places.keys[i] and (j := places.next(i, j)) is not None:
            source, target = (j, i) if len(places.keys[j]) > len(places.keys[i]) else (i, j)
            places.give(target, places.keys[source])
            holds[target] = holds[source]
    return holds


def _fold_task(batches):
    """Over batches of (doc_id, role, label, fact_ix, value, key) sorted by the first four; groups may run over several batches."""
    open_, held = None, []

    def closed():
        keys, values = [r[5] for r in held], [r[4] for r in held]
        new = [values[k] for k in fold_names(keys)]
        columns = [[r[0] for r in held], [r[3] for r in held], new, [a != b for a, b in zip(new, values, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "fact_ix", "value", "corrected"])

    for batch in batches:
        types = [batch.schema.field(i).type for i in (0, 3, 4)] + [pa.bool_()]
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != open_:
                yield closed()
                held = []
            open_ = row[:3]
            held.append(row)
    if held:
        yield closed()


def reconciled_names(facts: DataFrame) -> DataFrame:
    """(doc_id, fact_ix, value, corrected): names of one document, role and label, the clearer of two variants taken over.

    facts: doc_id, fact_ix, role, label, value. Each comparison sees what the ones before changed, so a group, the repeats of one
    field in one document, is folded in order of fact_ix by one task; a name is compared only with those that one character more or less makes of it.
    """
    label, key = t.folded(F.col("label")), comparison_key(F.col("value"))
    rows = facts.select("doc_id", "role", label.alias("label"), "fact_ix", "value", key.alias("key")).where("label <> ''")
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("doc_id", "fact_ix", "value")) + ", corrected boolean"
    return rows.repartition("doc_id", "role", "label").sortWithinPartitions("doc_id", "role", "label", "fact_ix").mapInArrow(_fold_task, schema)
