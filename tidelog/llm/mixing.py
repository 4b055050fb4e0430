"""Mixing sources to target weights by capped water-filling.

Sources share as many words as all documents have, by weight, but none is given more than CAP times its own words:
what is above is shared again by weight among the others, until none is above.  In order of cap by weight, the
clamped sources come first, so running sums over the table of sources find the level at once.

A source whose target is w whole repetitions and e more words takes each document w times, and e words' worth of
documents once more, in the order of a seeded hash of doc_id; of the document in which the e words end, as many
words as are left.  Sums over hash buckets tell in which bucket that is, so only that bucket is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, packed, written

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "17"
RESULTS = ("size", "source_size", "target", "taken")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """_s, source_size, target for sizes (_s, _n); weights repeat over the sources by code point, null last."""
    wide = "decimal(38,0)"
    sources = sizes.groupBy("_s").agg(F.sum("_n").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int")).cast("bigint")
    ranked = sources.select("_s", "source_size", rank.alias("rank"), weight.alias("w"), (F.col("source_size") * cap).alias("cap"))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = ranked.withColumns({
        "left": F.sum("source_size").over(everything).cast(wide) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(wide),
        "weights": F.sum("w").over(rest),
    })
    fits = F.col("left") * F.col("w") <= F.col("cap").cast(wide) * F.col("weights")
    level = F.min(F.when(fits, F.struct((F.col("cap").cast("double") / F.col("w")).alias("ratio"), "rank", F.col("left").cast("double").alias("left"), F.col("weights").cast("double").alias("weights")))).over(everything)
    filled = filled.withColumns({"fits": fits, "level": level})
    clamped = F.struct((F.col("cap").cast("double") / F.col("w")).alias("ratio"), "rank") < F.struct("level.ratio", "level.rank")
    share = F.col("level.left") * F.col("w") / F.col("level.weights")
    return filled.select("_s", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, words: str | None = None) -> DataFrame:
    """docs with size (words), source_size, target (its source's), taken (words, repetitions counted).

    Only doc_id, text and source are read; columns of docs with a result's name are replaced.  words: a column of docs with
    the sizes, counted before; then texts are not read at all.  Null text: size 0, taken
    0.  A null source is one source, the last.  Rows that repeat a doc_id follow each other in the seeded order; which
    of equal rows is cut does not show.  Sources without words have the target 0.  Reruns agree.
    """
    h = _hash(seed)
    base = docs.select(packed(docs, RESULTS).alias("own"), F.col("source").alias("_s"), (n_words() if words is None else F.col(words)).alias("_n"), h.alias("_h"), F.substring(h, 1, 3).alias("_b"))
    sums = written(base.groupBy("_s", "_b").agg(F.sum("_n").alias("_n")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = targets(sums, weights, cap).withColumn("_w", F.least(whole, F.lit(cap)))
    plan = plan.withColumn("_e", F.floor(F.col("target") - F.col("_w") * F.col("source_size") + 0.5).cast("bigint"))
    same = lambda a, b: a["_s"].eqNullSafe(b["_t"])
    named = plan.withColumnRenamed("_s", "_t")
    run = sums.withColumn("_to", F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")))
    run = run.join(named, same(run, named)).filter(F.col("_to") >= F.col("_e"))
    edge = run.groupBy("_t").agg(F.min(F.struct("_b", (F.col("_to") - F.col("_n")).alias("before"))).alias("_edge"))
    named = written(named.join(edge.withColumnRenamed("_t", "_u"), F.col("_t").eqNullSafe(F.col("_u"))).drop("_u"))
    rows = base.join(named, same(base, named))
    full = F.when(F.col("_b") < F.col("_edge._b"), F.col("_n")).otherwise(F.lit(0))
    others = rows.filter(F.col("_b") != F.col("_edge._b")).withColumn("_x", full)
    w = Window.partitionBy("_s").orderBy("_h", "_n").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_edge.before") + F.coalesce(F.sum("_n").over(w), F.lit(0))
    cut = rows.filter(F.col("_b") == F.col("_edge._b")).withColumn("_x", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_e") - ahead)))
    taken = F.col("_w") * F.col("_n") + F.col("_x")
    results = F.struct(F.col("_n").alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))
    return others.unionByName(cut).select("own", results.alias("results")).select("own.*", "results.*")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, words as a table, for mix(words="words"): texts are read and counted once."""
    return written(docs.select("doc_id", "source", n_words().alias("words")))


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each repetition.

    A last part of a repetition has the document's first words, up to the last one's end, and, where docs has the
    columns, n_chars to match.  Documents of no words are not in the mix.
    """
    rest = packed(docs, ("doc_id", "text", "source"))
    mixed = mix(docs.select("doc_id", "text", "source", rest.alias("rest")), weights, cap, seed).filter("taken > 0")
    parts = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    rows = mixed.withColumn("part", F.explode(parts)).withColumn("words", F.least("size", F.col("taken") - F.col("part") * F.col("size")).cast("int"))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words")), ""))
    rows, out = rows.withColumn("cut", cut), []
    for field in docs.schema:
        c = F.col("cut") if field.name == "text" else F.col(field.name) if field.name in ("doc_id", "source") else F.col("rest").getField(field.name)
        if field.name == "n_chars":
            c = F.when(F.col("words") < F.col("size"), F.char_length("cut").cast(field.dataType)).otherwise(c)
        out.append(c.alias(field.name))
    return rows.select(*out)


SQL = f"""WITH d AS (SELECT doc_id, source AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 src AS (SELECT s, CAST(sum(n) AS BIGINT) AS source_size FROM d GROUP BY s),
 ranked AS (SELECT *, row_number() OVER (ORDER BY s COLLATE "C" ASC NULLS LAST) - 1 AS rank FROM src),
 weighed AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][CAST(rank % {len(WEIGHTS)} + 1 AS BIGINT)] AS BIGINT) AS w, {CAP} * source_size AS cap FROM ranked),
 filled AS (SELECT *, (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, rank) AS place FROM weighed),
 level AS (SELECT place AS p0, CAST(remaining AS DOUBLE) AS r0, CAST(weights AS DOUBLE) AS w0 FROM filled WHERE remaining * w <= cap::HUGEINT * weights ORDER BY place LIMIT 1),
 plan AS (SELECT s, source_size, CASE WHEN place < p0 THEN CAST(cap AS DOUBLE) ELSE r0 * w / w0 END AS target FROM filled, level),
 whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {CAP}) ELSE 0 END AS k FROM plan),
 extra AS (SELECT *, CAST(floor(target - k * source_size + 0.5) AS BIGINT) AS e FROM whole),
 placed AS (SELECT d.*, source_size, target, k, e, coalesce(sum(n) OVER (PARTITION BY d.s ORDER BY h, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN extra ON d.s IS NOT DISTINCT FROM extra.s)
 SELECT doc_id, n AS size, source_size, target, CAST(k * n + greatest(0, least(n, e - ahead)) AS BIGINT) AS taken FROM placed"""
