"""Recurring-passage queries over documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import consensus as C
from waveloom.operators import landmarks as L
from waveloom.operators import refine as R
from waveloom.plans.base import query, table
from waveloom.plans.shared import stored

TOK = "tok AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents WHERE text IS NOT NULL)"
MARKS = f"""{TOK}, p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS t FROM tok), d AS (SELECT *, unnest([1, 2, 3, 4]) AS dt FROM p),
marks AS (SELECT concat(w[t + 1], '|', w[t + 1 + dt], '|', dt) AS hash, doc_id, t FROM d WHERE t + dt < len(w))"""
HELD = f"""{MARKS}, df AS (SELECT hash, count(DISTINCT doc_id) AS df FROM marks GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
held AS (SELECT hash, doc_id, t, df, row_number() OVER (PARTITION BY hash, doc_id ORDER BY t) - 1 AS r FROM marks JOIN df USING (hash) QUALIFY r < 3)"""
REFS = f"""{HELD}, sizes AS (SELECT doc_id, count(*) AS n, CAST(sum(df - 1) AS BIGINT) AS shared FROM held WHERE r = 0 GROUP BY 1),
tried AS ((SELECT doc_id, 0 AS p FROM sizes ORDER BY shared DESC, doc_id LIMIT 1) UNION ALL (SELECT doc_id, 1 FROM sizes ORDER BY n DESC, doc_id LIMIT 1)
UNION ALL (SELECT doc_id, 1 + row_number() OVER (ORDER BY (doc_id * {C.SPREAD}) % 4294967296, doc_id) FROM sizes QUALIFY row_number() OVER (ORDER BY (doc_id * {C.SPREAD}) % 4294967296, doc_id) <= {C.TRIALS})),
refs AS (SELECT doc_id, row_number() OVER (ORDER BY min(p)) AS trial FROM tried GROUP BY 1 QUALIFY trial <= {C.TRIALS})"""
VOTES = f"""{REFS}, bins AS (SELECT a.doc_id AS a, b.doc_id AS b, a.t - b.t AS delta, hash, min(a.t) AS ta FROM held a JOIN refs ON refs.doc_id = a.doc_id JOIN held b USING (hash) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
votes AS (SELECT a, b, delta, count(*) AS votes, min(ta) AS a_from, max(ta) AS a_to FROM bins GROUP BY 1, 2, 3)"""
PEAKS = f"""{VOTES}, mean AS (SELECT *, sum(votes) OVER (PARTITION BY a, b) / (max(delta) OVER (PARTITION BY a, b) - min(delta) OVER (PARTITION BY a, b) + 1) AS m FROM votes),
thr AS (SELECT *, greatest(12.0, m + 5 * sqrt(m)) AS threshold FROM mean), peaks AS (SELECT * FROM thr WHERE votes >= threshold)"""
TOP = f"{PEAKS}, top AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, delta) AS rank FROM peaks QUALIFY rank <= 5)"
TAKEN = f"""{TOP}, l AS (SELECT a, b, list(delta ORDER BY rank) AS d, list(votes ORDER BY rank) AS v FROM top GROUP BY 1, 2),
k1 AS (SELECT *, [1] AS k FROM l),
k2 AS (SELECT a, b, d, v, CASE WHEN len(d) >= 2 AND len(list_filter(k, lambda i: abs(d[i] - d[2]) <= 4)) = 0 THEN list_append(k, 2) ELSE k END AS k FROM k1),
k3 AS (SELECT a, b, d, v, CASE WHEN len(d) >= 3 AND len(list_filter(k, lambda i: abs(d[i] - d[3]) <= 4)) = 0 THEN list_append(k, 3) ELSE k END AS k FROM k2),
k4 AS (SELECT a, b, d, v, CASE WHEN len(d) >= 4 AND len(list_filter(k, lambda i: abs(d[i] - d[4]) <= 4)) = 0 THEN list_append(k, 4) ELSE k END AS k FROM k3),
k5 AS (SELECT a, b, d, v, CASE WHEN len(d) >= 5 AND len(list_filter(k, lambda i: abs(d[i] - d[5]) <= 4)) = 0 THEN list_append(k, 5) ELSE k END AS k FROM k4),
u AS (SELECT a, b, d, v, unnest(k) AS i FROM k5), taken AS (SELECT a, b, d[i] AS delta, v[i] AS votes FROM u)"""


def _densest(x: str) -> str:
    k = f"greatest(2, CAST(floor(0.85 * len({x})) AS BIGINT))"
    return f"CASE WHEN len({x}) < 4 THEN {{'span': {x}[-1] - {x}[1], 'start': {x}[1]}} ELSE list_sort(list_transform(range(1, len({x}) - {k} + 2), lambda i: {{'span': {x}[i + {k} - 1] - {x}[i], 'start': {x}[i]}}))[1] END"


MERGED = f"""{TAKEN}, once AS (SELECT t.a, t.b, t.delta AS peak, hash, min({{'delta': n.delta, 'ta': ta}}) AS x FROM taken t JOIN bins n ON n.a = t.a AND n.b = t.b AND n.delta BETWEEN t.delta - 2 AND t.delta + 2 GROUP BY 1, 2, 3, 4),
places AS (SELECT a, b, peak, count(*) AS votes, list_sort(list(x.ta)) AS p, list_sort(list(x.ta - x.delta)) AS q FROM once GROUP BY 1, 2, 3),
spans AS (SELECT a, b, peak AS delta, votes, {_densest('p')} AS x, {_densest('q')} AS y FROM places),
merged AS (SELECT a, b, delta, votes, x.start AS a_from, x.start + x.span AS a_to, y.start AS b_from, y.start + y.span AS b_to FROM spans)"""
_MEETS = "least({x}.t, {y}.t) - greatest({x}.f, {y}.f) > 0.5 * least({x}.t - {x}.f, {y}.t - {y}.f)"
MEMBERS = f"""{MERGED}, ex AS (SELECT a, a_from, a_to, min({{'v': -votes, 'b': b, 'delta': delta}}) AS lead FROM merged WHERE a_to > a_from GROUP BY 1, 2, 3),
fold AS (SELECT a, list_reduce(list([{{'f': a_from, 't': a_to, 'v': -lead.v}}] ORDER BY lead), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {_MEETS.format(x='x[1]', y='y')})) > 0 THEN acc ELSE list_concat(acc, x) END) AS held FROM ex GROUP BY 1),
num AS (SELECT ex.a, a_from, a_to, held, list_position(list_transform(held, lambda y: least(a_to, y.t) - greatest(a_from, y.f) > 0.5 * least(a_to - a_from, y.t - y.f)), true) AS i FROM ex JOIN fold USING (a)),
pk AS (SELECT m.*, CAST(i - 1 AS INT) AS asset, held[i].f AS ref_from, held[i].t AS ref_to, held[i].v AS ref_votes FROM merged m JOIN num USING (a, a_from, a_to)),
best AS (SELECT a, asset, ref_from, ref_to, ref_votes, b, min({{'v': -votes, 'delta': delta, 's': b_from, 'e': b_to}}) AS x FROM pk GROUP BY ALL),
every AS (SELECT a, asset, ref_from, ref_to, ref_votes, b AS doc_id, x.s AS start, x.e AS "end", -x.v AS votes, false AS is_reference FROM best
UNION ALL SELECT DISTINCT a, asset, ref_from, ref_to, ref_votes, a, ref_from, ref_to, ref_votes, true FROM best),
dense AS (SELECT * FROM every WHERE ref_votes / greatest(ref_to - ref_from, 0.001) >= {C.MIN_DENSITY}),
med AS (SELECT a, asset, list_sort(list(votes))[count(*) // 2 + 1] AS median_votes FROM dense GROUP BY 1, 2),
members AS (SELECT *, (is_reference OR votes >= greatest(2.0, {C.ABSENT} * median_votes)) AND "end" - start <= {C.LONGEST} AS present FROM dense JOIN med USING (a, asset))"""
KIND = """CASE WHEN {t} > 0.85 * {n} THEN 'end-credits' WHEN {span} < 4 THEN 'sting' WHEN {t} < 0.35 * {n} AND {span} <= 90 THEN 'title-theme' ELSE 'other-recurring' END"""
ASSETS = f"""{MEMBERS}, total AS (SELECT count(*) AS n FROM documents), s AS (SELECT a, asset, ref_from, ref_to, median_votes, count(*) AS support, list_sort(list("end" - start))[count(*) // 2 + 1] AS span, avg(start) AS mean_start,
avg(votes) AS mean_votes, list_sort(list(len(w)))[count(*) // 2 + 1] AS duration FROM members JOIN tok USING (doc_id) WHERE present GROUP BY ALL),
assets AS (SELECT s.*, support / (SELECT n FROM total) AS support_fraction, {KIND.format(t='mean_start', n='duration', span='span')} AS kind,
list_position({list(C.KINDS)!r}, {KIND.format(t='mean_start', n='duration', span='span')}) AS priority FROM s WHERE support >= greatest(2, least({C.MIN_SUPPORT}, ceil(0.6 * (SELECT n FROM total))))),
lead AS (SELECT a, support_fraction * mean_votes AS score FROM assets QUALIFY row_number() OVER (PARTITION BY a ORDER BY priority, support_fraction DESC, mean_votes DESC, mean_start, asset) = 1),
chosen AS (SELECT a FROM lead JOIN refs ON refs.doc_id = a ORDER BY score DESC, trial LIMIT 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """Each reference and document that share a landmark, with their strong bins, and the references."""
    docs = table(spark, sf_dir, "documents")
    refs = L.references(L.index(docs))
    return L.pairs(docs, refs), refs


def peaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    found, refs = pairs(spark, sf_dir)
    return L.strong_bins(found).filter("votes >= threshold"), refs


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """Peaks with the bins beside them, which are made again of the documents that have a peak."""
    docs = table(spark, sf_dir, "documents")
    found, refs = peaks(spark, sf_dir)
    taken = stored(C.suppressed(C.top_peaks(found)), "taken")
    some = docs.join(taken.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return C.merged(L.bins(docs, refs, some), taken), refs


def found_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, refs = merged(spark, sf_dir)
    lengths = C.tokens(docs).select("doc_id", F.size("w").alias("n"))
    return C.best_reference(stored(C.assets(C.members(stored(found, "peaks")), lengths, docs.count()), "assets"), refs)


@query(f"""WITH {TOK}, x AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM tok), n AS (SELECT greatest(2, ceil(0.2 * count(*))) AS least FROM tok)
SELECT token, count(*) AS df FROM x GROUP BY 1 HAVING count(*) >= (SELECT least FROM n)""")
def doc_freq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.tokens(table(spark, sf_dir, "documents"))
    least = max(2, math.ceil(0.2 * docs.count()))
    df = docs.select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.filter(F.col("df") >= least)


@query(f"WITH {HELD} SELECT doc_id, count(DISTINCT hash) AS n_hashes, count(*) AS n_places, min(t) AS first_t, CAST(sum(t) AS BIGINT) AS sum_t, max(df) AS most_common FROM held GROUP BY 1")
def landmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landmarks of each document that recur, summed up: their hashes differ between engines."""
    return L.index(table(spark, sf_dir, "documents")).drop("shared")


@query(f"WITH {REFS} SELECT refs.doc_id, trial, n, shared FROM refs JOIN sizes USING (doc_id)")
def reference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = L.index(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_hashes").alias("n"), "shared")
    order = spark.createDataFrame([(x, k + 1) for k, x in enumerate(C.chosen(sizes))], "doc_id long, trial long")
    return sizes.join(F.broadcast(order), "doc_id").select("doc_id", "trial", "n", "shared")  # a few references


@query(f"WITH {REFS} SELECT a.doc_id AS a, b.doc_id AS b, count(DISTINCT hash) AS shared FROM held a JOIN refs ON refs.doc_id = a.doc_id JOIN held b USING (hash) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2")
def shared_hash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)[0].select("a", "b", "shared")


@query(f"WITH {VOTES} SELECT a, b, delta, votes FROM votes WHERE votes >= 12")
def offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.strong_bins(pairs(spark, sf_dir)[0]).select("a", "b", "delta", "votes")


@query(f"WITH {PEAKS} SELECT a, b, delta, votes, round(threshold, 6) AS threshold FROM peaks")
def adaptive_threshold_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(spark, sf_dir)[0].select("a", "b", "delta", "votes", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {TOP} SELECT a, b, delta, votes, rank FROM top")
def top_peaks_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_peaks(peaks(spark, sf_dir)[0]).select("a", "b", "delta", "votes", "rank")


@query(f"WITH {TAKEN} SELECT a, b, delta, votes FROM taken")
def suppressed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suppressed(C.top_peaks(peaks(spark, sf_dir)[0]))


@query(f"WITH {MERGED} SELECT a, b, delta, votes, a_from, a_to, b_from, b_to FROM merged")
def merged_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with the bins beside them, and the passage's extent in both documents."""
    return merged(spark, sf_dir)[0]


@query(f"""WITH {MEMBERS} SELECT a, asset, doc_id, start, "end", votes, median_votes, is_reference, present FROM members""")
def asset_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.members(stored(merged(spark, sf_dir)[0], "peaks")).select("a", "asset", "doc_id", "start", "end", "votes", "median_votes", "is_reference", "present")


COLUMNS = "a, asset, kind, ref_from, ref_to, support, round(support_fraction, 9) AS support_fraction, span, round(mean_start, 6) AS mean_start, round(mean_votes, 6) AS mean_votes, median_votes"


@query(f"WITH {ASSETS} SELECT {COLUMNS}, row_number() OVER (ORDER BY support_fraction DESC, mean_votes DESC, mean_start, asset) AS rank FROM assets JOIN chosen USING (a)")
def recurring_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery end to end: landmarks, references, votes, peaks, passages with enough support, the best reference, ranks."""
    return _columns(C.ranked_assets(found_assets(spark, sf_dir)))


@query(f"WITH {ASSETS} SELECT {COLUMNS}, row_number() OVER (ORDER BY priority, support_fraction DESC, mean_votes DESC, mean_start, asset) AS rank FROM assets JOIN chosen USING (a) QUALIFY rank <= 3")
def assets_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three passages, title themes first."""
    return _columns(C.ranked_assets(found_assets(spark, sf_dir), "kind", 3))


_OWN_BINS = """len AS (SELECT doc_id, len(w) AS n FROM tok), own AS (SELECT hash, held.doc_id AS a FROM held JOIN len ON len.doc_id = held.doc_id QUALIFY row_number() OVER (PARTITION BY hash ORDER BY n DESC, held.doc_id) = 1),
bins AS (SELECT own.a, b.doc_id AS b, x.t - b.t AS delta, b.hash, min(x.t) AS ta FROM held b JOIN own ON own.hash = b.hash AND own.a <> b.doc_id JOIN held x ON x.hash = own.hash AND x.doc_id = own.a GROUP BY 1, 2, 3, 4),
votes AS (SELECT a, b, delta, count(*) AS votes, min(ta) AS a_from, max(ta) AS a_to FROM bins GROUP BY 1, 2, 3),
mean AS (SELECT *, (sum(votes) OVER (PARTITION BY a, b) - votes) / (max(delta) OVER (PARTITION BY a, b) - min(delta) OVER (PARTITION BY a, b) + 1) AS m FROM votes),
thr AS (SELECT *, greatest(12.0, m + 5 * sqrt(m)) AS threshold FROM mean), peaks AS (SELECT * FROM thr WHERE votes >= threshold)"""
EVERYWHERE = f"{HELD}, {_OWN_BINS}" + MEMBERS[len(PEAKS):]
_SUPPORT = f"""sup AS (SELECT a, asset, ref_from, ref_to, median_votes, count(*) AS support, round(avg(votes), 6) AS mean_votes FROM members WHERE present GROUP BY ALL HAVING count(*) >= {C.MIN_SUPPORT})"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every passage, whatever documents hold it: each landmark's documents vote against its owner."""
    return C.members(stored(L.owner_merged(table(spark, sf_dir, "documents")), "peaks"))


@query(f"""WITH {EVERYWHERE}, {_SUPPORT} SELECT * FROM sup""")
def passages_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that at least three documents hold, found without chosen references."""
    return supported(passages(spark, sf_dir))


def supported(members: DataFrame) -> DataFrame:
    """Passages with at least ``MIN_SUPPORT`` documents that hold them."""
    present = members.filter("present").groupBy("a", "asset", "ref_from", "ref_to", "median_votes")
    return present.agg(F.count(F.lit(1)).alias("support"), F.round(F.avg("votes"), 6).alias("mean_votes")).filter(F.col("support") >= C.MIN_SUPPORT)


@query(f"""WITH {EVERYWHERE}, {_SUPPORT} SELECT m.a, m.asset, doc_id, start, "end", votes FROM members m JOIN sup ON sup.a = m.a AND sup.asset = m.asset WHERE present QUALIFY row_number() OVER (PARTITION BY m.a, m.asset ORDER BY is_reference DESC, start, doc_id) = 1""")
def example_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that stands for each passage: in its reference, or else its first member's."""
    held_ = stored(passages(spark, sf_dir).filter("present"), "members")
    supported = held_.groupBy("a", "asset").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= C.MIN_SUPPORT)
    best = F.min(F.struct((~F.col("is_reference")).alias("o"), "start", "doc_id", "end", "votes")).alias("x")
    return held_.join(supported, ["a", "asset"]).groupBy("a", "asset").agg(best).select("a", "asset", "x.doc_id", "x.start", "x.end", "x.votes")


@query(f"""WITH {PEAKS}, mm AS (SELECT a, b, any_value(m) AS m FROM mean GROUP BY 1, 2), rk AS (SELECT a, b, delta, votes, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, delta) AS rank FROM votes),
kn AS (SELECT mm.a, mm.b, 0 AS delta FROM mm) SELECT kn.a, kn.b, CAST(kn.delta AS BIGINT) AS delta, coalesce(votes, 0) AS votes, rank, round(greatest(12.0, m + 5 * sqrt(m)), 6) AS threshold, coalesce(votes, 0) >= greatest(12.0, m + 5 * sqrt(m)) AS passes
FROM kn JOIN mm ON mm.a = kn.a AND mm.b = kn.b LEFT JOIN rk ON rk.a = kn.a AND rk.b = kn.b AND rk.delta = 0""")
def probe_known_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How offset 0, where whole copies line up, fares for every pair of a reference and a document that share a landmark."""
    found = pairs(spark, sf_dir)[0].withColumn("threshold", L.threshold())
    return found.select("a", "b", F.lit(0).cast("long").alias("delta"), F.col("zero").alias("votes"), F.col("zero_rank").alias("rank"), F.round("threshold", 6).alias("threshold"), (F.col("zero") >= F.col("threshold")).alias("passes"))


_CUT = "cut AS (SELECT hash, doc_id, t FROM marks WHERE NOT (doc_id % 2 = 0 AND t >= 20 AND t < 60))"
ABLATED = EVERYWHERE.replace("df AS (SELECT", f"{_CUT}, df AS (SELECT", 1).replace("FROM marks GROUP BY 1 HAVING", "FROM cut GROUP BY 1 HAVING", 1).replace("FROM marks JOIN df", "FROM cut JOIN df", 1)


@query(f"""WITH {ABLATED}, {_SUPPORT} SELECT * FROM sup""")
def ablated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still found everywhere when every other document loses its tokens 20 to 59."""
    docs = table(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 2 != 0
    gone = F.when(odd, 0).otherwise(20), F.when(odd, 0).otherwise(60)
    return supported(C.members(stored(L.owner_merged(docs, gone), "peaks")))


RULE = R.Rule(search=6, pad=8, smooth=4, threshold=0.75, fall=0.1, least_run=2, least_sim=0.3, longest=400, least_pairs=4)
_RANK = "list_sort(list({x}))[CAST({at} AS BIGINT) + 1]"
_TENTH, _NINTH, _MIDDLE = "floor(0.1 * (count(*) - 1) + 0.5)", "floor(0.9 * (count(*) - 1) + 0.5)", "count(*) // 2"
PINPOINT = f"""{ASSETS}, pick AS (SELECT a, asset, ref_from AS fa, ref_to AS fb FROM assets JOIN chosen USING (a) ORDER BY support_fraction DESC, mean_votes DESC, mean_start, asset LIMIT 1),
fr AS (SELECT doc_id AS id, unnest(range(0, len(w))) AS t, unnest(list_transform(w, lambda x: md5(x)[1])) AS g FROM tok),
c AS (SELECT a, fa, fb, CAST(floor((fb - fa) * {RULE.shrink} + 0.5) AS BIGINT) AS cut, greatest(0, fa - {RULE.pad}) AS low, least(len(w), fb + {RULE.pad}) AS high FROM pick JOIN tok ON doc_id = a),
est AS (SELECT doc_id AS id, start AS beg, "end" AS until, present FROM members m JOIN pick ON m.a = pick.a AND m.asset = pick.asset WHERE NOT is_reference),
tr AS (SELECT id, unnest(range(beg - fa - {RULE.search}, beg - fa + {RULE.search + 1})) AS d FROM est CROSS JOIN c WHERE present),
sims AS (SELECT tr.id, d, avg(CASE WHEN r.g = o.g THEN 1.0::DOUBLE ELSE 0 END) AS sim FROM tr CROSS JOIN c JOIN fr r ON r.id = c.a AND r.t >= fa + cut AND r.t < fb - cut JOIN fr o ON o.id = tr.id AND o.t = r.t + d GROUP BY 1, 2),
off AS (SELECT id, d FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 6) DESC, d) = 1),
wanted AS (SELECT id, d, a, unnest(range(low, high)) AS rt FROM off CROSS JOIN c),
raw AS (SELECT w.id, d, rt, CASE WHEN r.g = o.g THEN 1.0::DOUBLE ELSE 0 END AS raw FROM wanted w LEFT JOIN fr r ON r.id = w.a AND r.t = rt LEFT JOIN fr o ON o.id = w.id AND o.t = rt + d),
sm AS (SELECT x.id, x.d, x.rt, avg(y.raw) AS sm FROM raw x CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) CROSS JOIN c JOIN raw y ON y.id = x.id AND y.rt = least(greatest(x.rt + k, low), high - 1) GROUP BY 1, 2, 3),
lev AS (SELECT id, d, k, rt, rt - row_number() OVER (PARTITION BY id, k ORDER BY rt) AS g FROM sm CROSS JOIN (VALUES (0, {RULE.threshold}::DOUBLE), (1, {RULE.threshold}::DOUBLE - {RULE.fall}::DOUBLE), (2, {RULE.threshold}::DOUBLE - 2 * {RULE.fall}::DOUBLE)) l(k, over_) WHERE round(sm, 9) > over_),
run AS (SELECT id, d, k, min(rt) AS t0, count(*) AS n FROM lev GROUP BY id, d, k, g), one AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC, t0) = 1),
ext AS (SELECT id, d, t0, t0 + n - 1 AS t1 FROM one QUALIFY row_number() OVER (PARTITION BY id ORDER BY n >= {RULE.least_run} DESC, CASE WHEN n >= {RULE.least_run} THEN k END, n DESC, k) = 1),
ins AS (SELECT ext.id, avg(raw) AS sim FROM ext JOIN raw ON raw.id = ext.id AND rt >= t0 AND rt < t1 GROUP BY 1),
ea AS (SELECT est.*, d, t0, t1, sim, coalesce(t1 > t0 AND t1 - t0 >= {RULE.least_run}, false) AND present AS read FROM est LEFT JOIN ext USING (id) LEFT JOIN ins USING (id)), sr AS (SELECT *, read AND round(sim, 9) >= {RULE.least_sim} AS sure FROM ea),
sh AS (SELECT count(*) AS n, {_RANK.format(x='t0', at=_TENTH)} AS lo, {_RANK.format(x='t1', at=_NINTH)} AS hi, {_RANK.format(x='t0', at=_MIDDLE)} AS m0, {_RANK.format(x='t1', at=_MIDDLE)} AS m1, {_RANK.format(x='sim', at=_MIDDLE)} AS ms FROM sr WHERE sure HAVING count(*) > 0),
mem AS (SELECT id, present AND (sure OR NOT read) AS present, CASE WHEN sure THEN CASE WHEN n >= {RULE.least_pairs} THEN lo ELSE t0 END + d WHEN NOT read THEN beg END AS start, CASE WHEN sure THEN CASE WHEN n >= {RULE.least_pairs} THEN hi ELSE t1 END + d WHEN NOT read THEN until END AS stop,
CASE WHEN read THEN sim ELSE 0 END AS sim, sure AS refined, CASE WHEN sure THEN d END AS d, false AS is_reference FROM sr CROSS JOIN sh
UNION ALL SELECT pick.a, true, CASE WHEN n >= {RULE.least_pairs} THEN lo ELSE m0 END, CASE WHEN n >= {RULE.least_pairs} THEN hi ELSE m1 END, ms, true, NULL, true FROM sh CROSS JOIN pick),
fin AS (SELECT * REPLACE (present AND stop - start <= {RULE.longest} AS present) FROM mem)"""


@query(f"WITH {PINPOINT} SELECT id, present, CASE WHEN present THEN start END AS start, CASE WHEN present THEN stop END AS stop, round(sim, 5) AS sim, refined, d, is_reference FROM fin")
def pinpointed_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery, then refinement of the first passage: a document's tokens are its frames, alike where the first hex digit of their MD5 is."""
    from waveloom.library import Library

    docs = table(spark, sf_dir, "documents")
    tokens = C.tokens(docs)
    digit = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 1), 16, 10).cast("int")
    one_hot = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i == k, 1.0).otherwise(0.0))

    def near(windows: DataFrame) -> DataFrame:
        cut = C.tokens(docs.join(windows.withColumnRenamed("id", "doc_id"), "doc_id"), "lo", "hi")
        each = cut.select("doc_id", "lo", F.posexplode(F.slice("w", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int"))).alias("k", "w"))
        return each.select(F.col("doc_id").alias("id"), (F.col("lo") + F.col("k")).alias("t"), one_hot(digit(F.col("w"))).alias("v"))

    known = Library(None, tokens.select("doc_id", F.size("w").alias("n")), near=near)  # its landmarks are summed up, its frames made where they are needed
    found, refs = merged(spark, sf_dir)
    found = known.pinpoint_of(stored(C.members(stored(found, "peaks")), "members"), refs, RULE)
    if found is None:
        return spark.createDataFrame([], "id long, present boolean, start long, stop long, sim double, refined boolean, d long, is_reference boolean")
    return found.select("id", "present", "start", "stop", F.round("sim", 5).alias("sim"), "refined", "d", "is_reference")


def _columns(found: DataFrame) -> DataFrame:
    return found.select("a", "asset", "kind", "ref_from", "ref_to", "support", F.round("support_fraction", 9).alias("support_fraction"), "span", F.round("mean_start", 6).alias("mean_start"), F.round("mean_votes", 6).alias("mean_votes"), "median_votes", "rank")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the benchmark found whole in documents: an equi-join on the hash of the item's second to seventh word, or those a
    shorter item has between its first and last, then the exact test on the documents that were hit; items of at most two
    words, which have none between, are tested against each document."""
    words = lambda c: F.split(c, " ")
    items = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("item"))
    # the item's first word may be glued to what precedes it, and its last to what follows: those between stand alone in any copy
    items = items.withColumn("n", F.greatest(F.lit(0), F.least(F.lit(6), F.size(words(F.col("item"))) - 2)))
    items = items.withColumn("probe", F.xxhash64(F.array_join(F.slice(words(F.col("item")), F.lit(2), F.col("n")), " ")))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    found = docs.join(F.broadcast(items.filter("n = 0")), F.contains("text", "item")).select("doc_id", "item_id")
    hits = None
    for n in sorted(r["n"] for r in items.filter("n > 0").select("n").distinct().collect()):  # six lengths at most
        grams = F.regexp_extract_all(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.lit(" (?=(" + " ".join(["[^ ]*+"] * n) + ") )"), F.lit(1))
        each = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).select("doc_id", F.xxhash64("gram").alias("probe"))
        got = each.join(items.filter(F.col("n") == n).select("item_id", "item", "probe"), "probe").select("doc_id", "item_id", "item")
        hits = got if hits is None else hits.union(got)
    return found if hits is None else found.union(docs.join(hits.distinct(), "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id"))


@query(f"""WITH {TOP}, n AS (SELECT doc_id, len(w) AS n FROM tok), one AS (SELECT a, b, votes, a_from AS t, a_to - a_from AS span, n FROM top JOIN n ON n.doc_id = a WHERE rank = 1)
SELECT a, b, {KIND.format(t='t', n='n', span='span')} AS kind FROM one""")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.tokens(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("a"), F.size("w").alias("n"))
    one = C.top_peaks(peaks(spark, sf_dir)[0], 1).select("a", "b", F.col("a_from").alias("t"), (F.col("a_to") - F.col("a_from")).alias("span"))
    return one.join(n, "a").select("a", "b", C.kind(F.col("t"), F.col("n"), F.col("span")).alias("kind"))


@query("""WITH x AS (SELECT doc_id, source, n_chars, regexp_extract(source, '([0-9]+)$', 1) AS id FROM documents)
SELECT id, doc_id, n_chars FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1""")
def dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each id taken from its source name: min over (doc_id, rest), pre-aggregated."""
    held = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "([0-9]+)$", 1).alias("id"), "doc_id", "n_chars")
    return held.groupBy("id").agg(F.min(F.struct("doc_id", "n_chars")).alias("x")).select("id", "x.doc_id", "x.n_chars")


@query("""SELECT source, count(*) AS support, round(avg(n_chars), 4) AS mean_chars, min(doc_id) AS first_doc FROM documents GROUP BY 1 ORDER BY support DESC, mean_chars DESC, first_doc LIMIT 5""")
def rank_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("support"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("doc_id").alias("first_doc"))
    return held.orderBy(F.desc("support"), F.desc("mean_chars"), "first_doc").limit(5)
