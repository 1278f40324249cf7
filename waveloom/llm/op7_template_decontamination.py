"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a template: its words (runs of letters and digits, lower-cased) in order, with typed
placeholders for a whole number (its decimals and thousands separators, and letters glued to it, or a number word), a unit
word right after a number, and a whole run of capitalised words (a name). A capitalised word that opens a
sentence counts as a name too, unless it is one of the ``OPENERS``, which never are; a word all in capitals is no name. Every window
of ``WINDOW`` template words is hashed and hash-joined to the benchmark's windows. Hits
with the same shift (document position minus item position) form an alignment. Within an
alignment the slots must be consistent: equal values of the item have equal values in the
document, which is how the same question with new numbers, names or units is told from chance. (Different
values of the item may well become the same value of the document.) An item leaks into a
document if consistent alignments hold at least ``COVERAGE`` of the item's windows.

An item with names has a second set of windows, from its text in lower case (``LOWER``): those are what a copy in lower case or in capitals shows,
in which names are words like any other. Documents need no second template for them.

A window with fewer than ``LITERALS`` words that are no placeholder is no evidence. An item with fewer than
``WINDOW`` words has one window of its whole length, as a template if that is evidence, and with all
words as they are (``EXACT``); an item without any window that is evidence has exact
windows. Documents have windows of these few shorter lengths too, as far as the benchmark has such items, cut from the same template.

Templates and windows are made by regular expressions over strings, one pass each, so a window costs about as much as
reading it twice. The benchmark's window table is broadcast if it counts at most ``BROADCAST_WINDOWS`` rows, else
the windows are joined by shuffle. Only hits are shuffled, so a hot passage costs its
hits; slot values are read again from the documents that have hits.

Defined cases: null texts and texts without a word have no window and never match, on either side; repeated rows
are one document, different texts under one doc_id are each compared and reported under it; a null doc_id or
item_id is ignored; very long texts are compared whole (a task holds about 15 times the text's size); items that tie are
all reported; empty tables give no row; other columns are ignored. A copy that capitalises each word, or one with names of an
item that has them in lower case, is found only by what its windows share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import keyed_documents, stored, table

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
BROADCAST_WINDOWS = 500_000
BROADCAST_HITS = 200_000  # texts with hits sent whole up to here, joined by shuffle above
SHAPE, LOWER, EXACT = "shape", "lower", "exact"
ALNUM = r"[\p{L}\p{N}]"
#: Placeholders: words of one digit, which no other word of a template starts with.
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "0", "1", "2"
#: Capitalised words that open sentences and are no names.
OPENERS = """A An The This That These Those What Which Who Whose Whom When Where Why How If In On At Of For From To By With As After Before During There Here
It He She They We You I His Her Their Our My Your Its And But Or So Then Now Is Are Was Were Do Does Did Can Could Will Would Should May Might Must
Has Have Had Each Every All Some Many Much Most Both Find Calculate Solve Add Let Given Suppose Consider Explain Describe Choose Write Compute
Determine Evaluate Name List Question Answer""".split()
#: Unit words that may follow a number.
UNITS = tuple("""km m cm mm mi mile miles yard yards ft foot feet inch inches kg g mg lb lbs pound pounds ounce ounces oz ton tons litre litres liter
liters l ml gallon gallons second seconds sec s minute minutes min hour hours h day days week weeks month months year years dollar dollars usd eur euro
euros cent cents percent degrees celsius fahrenheit watt watts kw kwh volt volts mph kmh hz khz mhz ghz kb mb gb tb byte bytes bit bits""".split())
#: Number words.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
NUMBER = rf"[0-9](?<!{ALNUM}[0-9]){ALNUM}*+(?:[.,][0-9]{ALNUM}*+)*+"
_NO_NAME = rf"(?!\p{{Lu}}{{2}})(?!(?:{'|'.join([*OPENERS, *(w.title() for w in NUMBER_WORDS)])})(?!{ALNUM}))"  # tested at capitals alone
_LONE = r"(?!(?<=\p{Lu}{2}\s)\p{Lu}(?![\p{L}\p{N}]))"  # a single letter among words in capitals
NAME = rf"(?=\p{{Lu}})(?<!{ALNUM}){_NO_NAME}{_LONE}{ALNUM}++(?:\s(?=\p{{Lu}}){_NO_NAME}{ALNUM}++)*+"
WORDED = rf" (?:{'|'.join(NUMBER_WORDS)})(?= )"
UNIT = rf" {NUMBER_SLOT} (?:{'|'.join(UNITS)})(?= )"


def template(text: Column, variant: str = SHAPE) -> Column:
    """The words with a blank before and after each, slots replaced by their placeholder."""
    if variant == SHAPE:
        text = F.regexp_replace(F.regexp_replace(text, NUMBER, f" {NUMBER_SLOT} "), NAME, f" {NAME_SLOT} ")
    spaced = F.lower(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), rf"[^\p{{L}}\p{{N}}]+", " "))
    return F.regexp_replace(F.regexp_replace(spaced, WORDED, f" {NUMBER_SLOT}"), UNIT, f" {NUMBER_SLOT} {UNIT_SLOT}") if variant == SHAPE else spaced


def values(text: Column) -> Column:
    """What stands in the text for each word of its template."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{NUMBER}|{NAME}|{ALNUM}+"), F.lit(0)), lambda v: F.regexp_replace(F.lower(v), r"\s", " "))


def windows(shape: Column, length: int) -> Column:
    """All runs of so many words of a template, each with a blank behind every word."""
    return F.regexp_extract_all(shape, F.lit(" (?=(" + "[^ ]++ " * length + "))"), F.lit(1))


def literals(window: Column) -> Column:
    """How many words of a window are no placeholder."""
    return F.regexp_count(window, F.lit(r"(?:^| )[^0-9 ]"))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, variant, length, item_pos, window: what is evidence. At most ``WINDOW`` words a window, so few lengths."""

    def cut(rows: DataFrame, variant: str, lengths: list[int]) -> DataFrame:
        text = F.lower("text") if variant == LOWER else F.col("text")
        shaped = rows.select("item_id", template(text, EXACT if variant == EXACT else SHAPE).alias("t")).withColumn("size", F.length(F.regexp_replace("t", "[^ ]", "")) - 1)
        parts = [shaped.filter(F.col("size") >= n if n == WINDOW else F.col("size") == n).select("item_id", F.lit(variant).alias("variant"), F.lit(n).alias("length"), F.posexplode(windows(F.col("t"), n)).alias("item_pos", "window")) for n in lengths]
        return reduce(DataFrame.unionByName, parts)

    every = list(range(1, WINDOW + 1))
    named = items.filter(template(F.col("text")) != template(F.lower("text")))
    shape = stored(cut(items, SHAPE, every).unionByName(cut(named, LOWER, every)).filter(literals(F.col("window")) >= LITERALS), "benchmark-windows")
    enough = shape.filter((F.col("length") == WINDOW) & (F.col("variant") == SHAPE)).select("item_id").distinct()
    return shape.unionByName(cut(items.join(enough, "item_id", "left_anti"), EXACT, every))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows of the item, n_matched, n_slots checked and n_changed: one row a leak, of the variant that covers more."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    made_as = F.when(F.col("variant") == EXACT, EXACT).otherwise(SHAPE)  # which of a document's templates shows the window
    usable = stored(item_windows(items).withColumn("made_as", made_as).withColumn("h", F.xxhash64("window", "made_as")), "benchmark-windows")
    sizes = usable.groupBy("item_id", "variant").agg(F.count_distinct("item_pos").alias("n_windows"))
    side = usable.withColumnsRenamed({"window": "item_window"}).drop("length")
    side = F.broadcast(side) if usable.count() <= BROADCAST_WINDOWS else side
    named = keyed_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    key = ["doc_id", "text_hash"]
    hashed = named.withColumn("text_hash", F.xxhash64("text"))
    kinds = sorted({(SHAPE, WINDOW), *(tuple(r) for r in usable.select("made_as", "length").distinct().collect())})  # at most 2 x WINDOW
    shown = {SHAPE: template(F.col("text")), **({EXACT: template(F.col("text"), EXACT)} if any(v == EXACT for v, _ in kinds) else {})}
    shaped = hashed.select(*key, *[x.alias(v) for v, x in shown.items()])
    wanted = shaped.withColumn("z", F.explode(F.array(*[F.struct(F.lit(v).alias("kind"), F.lit(n).alias("length")) for v, n in kinds]))) if len(kinds) > 1 else shaped.withColumn("z", F.struct(F.lit(SHAPE).alias("kind"), F.lit(WINDOW).alias("length")))
    cut = reduce(lambda rest, k: F.when((F.col("z.kind") == k[0]) & (F.col("z.length") == k[1]), windows(F.col(k[0]), k[1])).otherwise(rest), kinds[1:], windows(F.col(kinds[0][0]), kinds[0][1]))
    made = wanted.select(*key, "z.kind", "z.length", F.posexplode(cut).alias("pos", "window"))
    hits = made.join(side, F.xxhash64("window", "kind") == F.col("h")).filter("window = item_window AND kind = made_as")
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    found_at = hits.select(*key, "item_id", "variant", shift, "item_pos", "length")
    aligned = stored(found_at.groupBy(*key, "item_id", "variant", "shift").agg(F.collect_set("item_pos").alias("places"), F.max("length").alias("length")), "alignments")
    by_text = stored(aligned.filter(F.col("variant") != EXACT).groupBy(*key).agg(F.collect_list(F.struct("item_id", "variant", "shift", "places", "length")).alias("found")), "texts-with-hits")
    by_text = F.broadcast(by_text) if by_text.count() <= BROADCAST_HITS else by_text
    held = hashed.join(by_text, key).dropDuplicates(key).select(*key, values(F.col("text")).alias("held"), "found").select(*key, "held", F.explode("found").alias("f")).select(*key, "held", "f.*")
    # the item's own words, for the few items that were hit
    hit = items.join(aligned.select("item_id").distinct(), "item_id", "left_semi")
    words = lambda text, variant: hit.select("item_id", F.lit(variant).alias("variant"), F.split(F.trim(template(text)), " ").alias("shape"), values(text).alias("item_held"))
    own = words(F.col("text"), SHAPE).unionByName(words(F.lower("text"), LOWER))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("length") - 1))))
    slot = F.transform(F.filter(covered, lambda p: F.get(F.col("shape"), p).rlike("^[0-9]")), lambda p: F.struct(F.get("shape", p).alias("kind"), F.get("item_held", p).alias("item"), F.get("held", p + F.col("shift")).alias("doc")))
    checked = held.join(own, ["item_id", "variant"]).select(*key, "item_id", "variant", "places", F.array_distinct(slot).alias("slots"))
    same = F.size(F.array_distinct(F.transform("slots", lambda z: F.struct(z["kind"], z["item"])))) == F.size("slots")
    consistent = checked.filter(same).select(*key, "item_id", "variant", "places", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda z: ~z["item"].eqNullSafe(z["doc"]))).alias("n_changed"))
    exact = aligned.filter(F.col("variant") == EXACT).select(*key, "item_id", "variant", "places", F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))
    found = consistent.unionByName(exact).groupBy(*key, "item_id", "variant").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_matched"), F.max("n_slots").cast("long").alias("n_slots"), F.max("n_changed").cast("long").alias("n_changed"))
    enough = found.join(sizes, ["item_id", "variant"]).filter(F.col("n_matched") >= coverage * F.col("n_windows"))
    best = F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "variant", "n_windows", "n_matched", "n_slots", "n_changed"))
    return enough.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", *(f"best.{c}" for c in ("n_windows", "n_matched", "n_slots", "n_changed")))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
