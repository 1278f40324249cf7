"""Quality rules as weak supervision, in DataFrame functions only.

Nine rules look at counts of a document; each votes good (+1), bad (-1) or
abstains (0). A document is thus one of 3**9 vote patterns. Expectation-
maximisation runs over the pattern counts (one row holding at most 3**9 = 19,683
entries, whatever the corpus): it estimates, without labels, the share of good
documents and how often each rule is right on good and on bad ones. What a rule's author expects (``EXPECTED_GOOD``,
``EXPECTED_BAD``) counts like ``BELIEF`` of the corpus beside the documents themselves, so no rate is fixed or bounded; without any, EM
takes the commonest kind of junk for the whole bad class. A document's
posterior probability of being good decides, instead of passing every rule. The base limits of the contract are reported beside it.

Counts are taken in the scan's own tasks by array functions (no exchange of
words); the feature rows go to the shared folder once, so the text is read once.

Defined cases: null and empty text have zero counts and fail the base; repeated
rows get a row each; an empty table gives no row; a null doc_id stays null; a very long text is counted whole in its
task (about 30 times its size); a posterior at the threshold is good; other columns are ignored. Windows are compared by 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import keyed_documents, stored, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
ROUNDS = 25
PRIOR, BELIEF = 0.85, 0.05  # expected share of good documents; weight of all expectations, as a share of the corpus
EXPECTED_GOOD, EXPECTED_BAD = (0.002, 0.15, 0.848), (0.25, 0.25, 0.5)  # a rule's votes bad, abstains, votes good; EM starts here
THRESHOLD = 0.5

#: (name, votes bad when, votes good when); abstains otherwise.
RULES = (
    ("length", "n_words < 10", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "n_symbols = 0"),
    ("marked_words", "5 * n_marks > n_words", "20 * n_marks < n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("repeated_words", "5 * n_repeat_words > n_words", "n_repeat_words = 0"),
    ("shouting", "10 * n_upper > 3 * word_chars", "10 * n_upper < word_chars"),
    ("digits", "100 * n_digits > 15 * word_chars", "100 * n_digits < 5 * word_chars"),
    ("exclamation", "5 * n_exclaims > n_words", "n_exclaims = 0"),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the same text."""

    def counted(hashes: Column) -> Column:
        def within(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, within))

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows, counted))


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("text", SPACE), "")
    inked = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda what: F.regexp_count("text", F.lit(what)).cast("long")
    return (
        keyed_documents(docs).withColumn("text", text)
        .select(
            "doc_id", let(words, lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("r"))).alias("w"),
            F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            let(inked, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
            count(r"[#*$%&|<>]+").alias("n_marks"), count(r"\p{Lu}").alias("n_upper"), count(r"[0-9]").alias("n_digits"), count("!").alias("n_exclaims"))
        .select("doc_id", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").cast("long").alias("n_dup_lines"), F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"), "n_marks", "n_upper", "n_digits", "n_exclaims")
    )


def pattern() -> Column:
    """The votes as one number in base 3."""
    code = F.lit(0)
    for k, (_, bad, good) in enumerate(RULES):
        code = code + F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * 3**k
    return code.cast("int")


def fitted(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, quality (posterior), prior and the rules' vote probabilities, from rows (pattern, n).

    Each rule has, given a good and given a bad document, the probabilities of its three votes
    (bad, abstain, good; entries 3j, 3j + 1, 3j + 2). One row of at most 3**9 entries is iterated over.
    """
    m = len(RULES)
    powers = ", ".join(str(3**k) for k in range(m))
    expected = {c: f"flatten(array_repeat(array({', '.join(f'{x}D' for x in e)}), {m}))" for c, e in (("good", EXPECTED_GOOD), ("bad", EXPECTED_BAD))}
    odds = "ln(s.prior / (1 - s.prior)) + aggregate(q.slots, 0D, (x, i) -> x + ln(s.good[i]) - ln(s.bad[i]))"

    def share(c: str, w: str) -> str:  # n adds up to 1, so BELIEF is a share of the corpus
        return (
            f"transform({expected[c]}, (e, i) -> (aggregate(held, {BELIEF}D * e, (x, q) -> x + CASE WHEN q.slots[i div 3] = i THEN q.n * {w} ELSE 0D END))"
            f" / aggregate(held, {BELIEF}D, (x, q) -> x + q.n * {w}))")

    step = f"""
      aggregate(sequence(1, {rounds}), named_struct('prior', {PRIOR}D, 'good', {expected['good']}, 'bad', {expected['bad']}), (s, r) ->
        transform(array(transform(seen, q -> named_struct('slots', q.slots, 'n', q.n, 'p', 1 / (1 + exp(-({odds})))))), held ->
          named_struct('prior', ({BELIEF * PRIOR}D + aggregate(held, 0D, (x, q) -> x + q.n * q.p)) / {1 + BELIEF}D, 'good', {share('good', 'q.p')}, 'bad', {share('bad', '(1 - q.p)')}))[0])"""
    one = (
        counts.select("n", "pattern", F.expr(f"transform(array({powers}), (p, j) -> CAST((pattern div p) % 3 + 3 * j AS INT))").alias("slots"))
        .agg(F.collect_list(F.struct("pattern", "slots", F.col("n").cast("double").alias("n"))).alias("seen"), F.sum("n").cast("double").alias("total"))
        .withColumn("seen", F.expr("transform(seen, q -> named_struct('pattern', q.pattern, 'slots', q.slots, 'n', q.n / total))"))
        .withColumn("s", F.expr(step))
    )
    return one.select("s", F.explode("seen").alias("q")).select("q.pattern", F.expr(f"1 / (1 + exp(-({odds})))").alias("quality"), "s.prior", "s.good", "s.bad")


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    held = stored(features(docs).withColumn("pattern", pattern()), "features")
    post = F.broadcast(fitted(held.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), rounds).select("pattern", "quality"))  # at most 3**9 rows
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return held.join(post, "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= THRESHOLD)).alias("kept"), "quality")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
