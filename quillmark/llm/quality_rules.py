"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust each, a posterior decides.

All of it is column expressions. ``measured`` makes one pass over the texts without a shuffle; its narrow rows are checkpointed. Votes are counted by
pattern with map-side combining: there are at most 3 ** len(RULES) patterns, whatever the size of the input, so their list is one row and its model
one expression (``fitted``), and the join back broadcasts at most so many rows.

The model is a mixture of good and bad documents in which each rule says bad, nothing or good with probabilities of its own for either kind. Junk comes in many
kinds, most of which one rule alone finds: so rules that look for junk only vote bad or abstain, and a rule's silence says little. Beliefs, weighed as a share of
all documents (``TRUST``), say which kind is the good one and that junk rules seldom vote on good texts; the votes move them.

Defined results: a null text is empty; a text without words fails the base rules. Windows and lines are compared exactly, in texts of any length; an n-gram
list lies in the memory of one task, about 150 bytes a word. Repeated rows count as often as they occur. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import bound

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a window that may repeat.
WINDOW = 3
MIN_WORDS = 50
REPEATED_PERCENT = 50
#: Posterior probability from which a document is kept.
KEEP = 0.5
ROUNDS = 40
#: Share of good documents believed in, and how many documents the beliefs weigh as: a share of all, and some more.
PRIOR, TRUST, LEAST = 0.8, 0.05, 10.0
#: Believed chances of (bad, no, good) votes on good and on bad documents: rules that look for junk, and rules that look for prose too.
JUNK = ((0.001, 0.998, 0.001), (0.15, 0.849, 0.001))
PROSE = ((0.001, 0.299, 0.7), (0.15, 0.35, 0.5))


def _words_without_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"))


def _removed(text: Column, pattern: str) -> Column:
    """How many characters match."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more, the first of its kind included.

    Windows are sorted as numbers, the upper half of their hash before their place: neighbours with equal halves, few in most texts, are compared by their words.
    """
    n, place = F.size(words), F.lit(2**31 - 1)
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    half = lambda x: F.shiftright(x, 31)
    marks = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(-(2**31))).bitwiseOR(i)))
    alike = lambda s: F.filter(s, lambda x, k: half(x).eqNullSafe(half(F.get(s, k + 1))) | half(x).eqNullSafe(half(F.get(s, k - 1))))
    grams = F.transform(bound(marks, alike), lambda x: bound(x.bitwiseAND(place).cast("int"), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("gram"), i.alias("at"))))
    same = lambda s: F.filter(s, lambda x, k: x["gram"].eqNullSafe(F.get(s, k + 1)["gram"]) | x["gram"].eqNullSafe(F.get(s, k - 1)["gram"]))
    places = F.flatten(F.transform(bound(F.array_sort(grams), same), lambda x: F.array(*[x["at"] + k for k in range(WINDOW)])))
    return F.when(n >= WINDOW, F.size(F.array_distinct(places))).otherwise(0).cast("bigint")


def _counts(words: Column) -> Column:
    return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words"))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text: those of the base rules and those that the voting rules take."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = df.select(
        F.col(id_col).alias("id"), bound(F.regexp_extract_all(text, F.lit(f"({WORD})")), _counts).alias("w"), bound(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("all"), F.size(F.array_distinct(x)).cast("bigint").alias("once"))).alias("l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        _removed(text, r"\p{L}+").alias("n_letters"), _removed(text, r"\p{Lu}+").alias("n_capitals"), _words_without_letters(text).cast("bigint").alias("n_odd_words"),
        F.regexp_count(text, F.lit(r"[.?!](?![^\x20\x09-\x0D])")).cast("bigint").alias("n_ends"), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]{2,}+")).cast("bigint").alias("n_runs"), (F.length(text) - F.length(F.translate(text, "!", ""))).cast("bigint").alias("n_shouts"),
    )
    return rows.select("id", "w.*", "word_chars", "n_symbols", (F.col("l.all") - F.col("l.once")).alias("n_dup_lines"), F.col("l.all").alias("n_lines"), "n_letters", "n_capitals", "n_odd_words", "n_ends", "n_runs", "n_shouts")


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def _vote(x: Column, bad: Column, good: Column | None = None) -> Column:
    """1: good, -1: bad, 0: the rule abstains (also where its measure doesn't exist)."""
    found = F.when(x.isNull(), 0).when(bad, -1)
    return (found if good is None else found.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes of every rule."""
    length, ends = _share("word_chars", "n_words"), F.when(F.col("n_words") >= 20, _share("n_ends", "n_words"))
    letters = _share("n_letters", "word_chars")
    over = lambda x, most: _vote(x, x >= most)
    return {
        "symbols": over(_share("n_symbols", "n_words"), 0.2),
        "capitals": over(_share("n_capitals", "n_letters"), 0.5),
        "same_lines": over(F.when(F.col("n_lines") >= 4, _share("n_dup_lines", "n_lines")), 0.4),
        "same_words": over(_share("n_repeat_words", "n_words"), 0.35),
        "odd_words": over(_share("n_odd_words", "n_words"), 0.3),
        "shouts": over(_share("n_shouts", "n_words"), 0.3),
        "runs": over(_share("n_runs", "n_words"), 0.3),
        "letters": _vote(letters, letters < 0.7),
        "word_length": _vote(length, ~length.between(2.2, 20)),
        "sentences": _vote(ends, ~ends.between(0.004, 0.4), ends.between(0.02, 0.2)),
        "size": _vote(F.col("n_words"), F.col("n_words") < 20),
    }


RULES = {r: JUNK for r in "symbols capitals same_lines same_words odd_words shouts runs letters word_length".split()} | {"sentences": PROSE, "size": JUNK}


def pattern() -> Column:
    """All votes as one number, a digit to the base of three each."""
    votes = rules()
    return sum(((votes[r] + 1) * 3**k for k, r in enumerate(RULES)), F.lit(0)).cast("int")


def _belief(documents: Column) -> tuple[Column, Column]:
    """Pseudo-counts of the places 3 * rule + vote + 1, for good and bad documents."""
    weight = documents * TRUST + LEAST
    return tuple(F.array(*[weight * (share * x) for told in RULES.values() for x in told[k]]) for k, share in enumerate((PRIOR, 1 - PRIOR)))


def _posterior(places: Column, model: Column) -> Column:
    """Probability of a good document whose votes take these places of the model's log ratios."""
    odds = F.aggregate(places, model["odds"], lambda a, k: a + F.get(model["ratios"], k))
    return 1 / (1 + F.exp(-odds))


def _ratios(good: Column, bad: Column) -> Column:
    """Log ratios of a vote's probability in good and in bad documents, from counts by place."""
    total = lambda x, k: sum((F.get(x, k - k % 3 + i) for i in range(1, 3)), F.get(x, k - k % 3))
    return F.transform(good, lambda g, k: F.log(g / total(good, k)) - F.log(F.get(bad, k) / total(bad, k)))


def _better(model: Column, patterns: Column) -> Column:
    """One round: who seems good by the model, and the model of those."""
    weighed = F.transform(patterns, lambda p: F.struct(p["places"].alias("places"), p["n"].alias("n"), (p["n"] * _posterior(p["places"], model)).alias("good")))

    def counted(rows: Column) -> Column:
        def summed(belief: Column, what) -> Column:
            at = lambda p, k: F.get(p["places"], F.floor(k / 3).cast("int"))
            return F.transform(belief, lambda x, k: F.aggregate(rows, x, lambda a, p: a + F.when(at(p, k) == k, what(p)).otherwise(0.0)))

        n, g = F.aggregate(rows, F.lit(0.0), lambda a, p: a + p["n"]), F.aggregate(rows, F.lit(0.0), lambda a, p: a + p["good"])
        like_good, like_bad = _belief(n)
        good, bad = summed(like_good, lambda p: p["good"]), summed(like_bad, lambda p: p["n"] - p["good"])
        weight = n * TRUST + LEAST
        odds = F.log((g + weight * PRIOR) / (n - g + weight * (1 - PRIOR)))
        return F.struct(odds.alias("odds"), bound(good, lambda x: bound(bad, lambda y: _ratios(x, y))).alias("ratios"))

    return bound(weighed, counted)


def fitted(votes: DataFrame) -> DataFrame:
    """pattern, posterior of each pattern of votes that occurs."""
    places = F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda k: (k * 3 + F.floor(F.col("pattern") / F.pow(F.lit(3.0), k)).cast("int") % 3).cast("int"))
    patterns = votes.groupBy("pattern").agg(F.count("*").cast("double").alias("n")).select("pattern", F.struct("pattern", places.alias("places"), "n").alias("p"))
    listed = patterns.agg(F.sort_array(F.collect_list("p")).alias("patterns"))
    start = F.struct(F.log(F.lit(PRIOR / (1 - PRIOR))).alias("odds"), _ratios(*_belief(F.lit(1.0))).alias("ratios"))
    model = listed.select("patterns", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: _better(m, F.col("patterns"))).alias("model"))
    return model.select("model", F.explode("patterns").alias("p")).select("p.pattern", _posterior(F.col("p.places"), F.col("model")).alias("quality"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's counts, its posterior quality, whether it fails the base rules, and whether it is kept."""
    rows = checkpointed(measured(df, id_col, text_col).withColumn("pattern", pattern()))
    scored = rows.join(F.broadcast(fitted(rows)), "pattern")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("quality") >= KEEP)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), kept.alias("kept"), F.round("quality", 6).alias("quality"))
