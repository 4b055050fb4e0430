"""Document fingerprints by closed syncmers, with DataFrame functions alone.

The letters are words (lower-cased).  A k-mer of K words is a closed syncmer if the least hash among its inner
runs of S words lies at its first or its last place.  That depends on the k-mer alone, not on what surrounds it, so two
texts that share a passage share all its syncmers, wherever it stands: anchors(docs) gives them with their places.

Anchors are matched by position: a link is an anchor, the distance to the next one, and that one.  Two texts share
a link only where they share two anchors in a row at one constant offset, so a passage of m shared anchors gives m - 1
shared links wherever it stands, and single k-mers that two texts happen to share give none.  A fingerprint is the
chain of all links in the order of the text (32 bits each, in hex), whole texts without a cap; likeness() of two is
the Jaccard index of their sets of links.

Texts of fewer than SHORT words also have the closed syncmers of two words (every pair), those of fewer than TINY
words every word, so that an edit of one word leaves something to match.  Texts without words have no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, written

K, S, SHORT, TINY = 5, 2, 24, 4


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def anchor_places(hashes: Column) -> Column:
    """(place, hash) of each syncmer of an array of word hashes; fewer than K words have none."""

    def find(h: Column) -> Column:
        inner = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))  # S = 2
        kmer = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K)))
        edges = lambda m, i: F.least(F.get(m, i), F.get(m, i + (K - S)))
        middle = lambda m, i: F.least(*(F.get(m, i + j) for j in range(1, K - S)))
        chosen = _let(inner, lambda m: F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: edges(m, i) <= middle(m, i)))
        many = F.transform(chosen, lambda i: F.struct(i.alias("place"), kmer(i).alias("hash")))
        return F.when(F.size(h) >= K, many).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("hash"))), lambda _: F.lit(False)))

    return _let(hashes, find)


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _narrow(hash64: Column) -> Column:
    return F.shiftright(hash64, 32).cast("int")


def links(text: Column) -> Column:
    """The chain of links in the order of the text, as 32-bit integers; then the pairs and words of short texts."""
    none = F.array().cast("array<int>")

    def chain(a: Column) -> Column:
        link = lambda x, y: _narrow(F.xxhash64(x["hash"], y["place"] - x["place"], y["hash"]))
        return F.when(F.size(a) > 1, F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), link)).otherwise(none)

    def short(h: Column) -> Column:
        pairs = F.when((F.size(h) > 1) & (F.size(h) < SHORT), F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: _narrow(F.xxhash64(F.get(h, i), F.get(h, i + 1)))))
        each = F.when(F.size(h) < TINY, F.transform(h, _narrow))
        return F.concat(F.coalesce(pairs, none), F.coalesce(each, none))

    return _let(_word_hashes(text), lambda h: F.concat(_let(anchor_places(h), chain), short(h)))


def as_text(s: Column) -> Column:
    """Eight hex digits for each link: those of 2^32 and the unsigned link, without the leading 1."""
    nine = F.lit(1 << 32).cast("bigint")
    return F.lower(F.array_join(F.transform(s, lambda x: F.substring(F.hex(F.pmod(x.cast("bigint"), nine) + nine), 2, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of the distinct links of both, the share that both have; 1 if neither has any."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise((shared / F.greatest(every, F.lit(1))).cast("double"))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the k-mer's first word), hash: a row for each anchor of each row of docs."""
    found = docs.select("doc_id", F.explode(anchor_places(_word_hashes(F.col("text")))).alias("a"))
    return found.select("doc_id", "a.place", "a.hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each row of docs; null text counts as empty."""
    return docs.select("doc_id", as_text(links(F.col("text"))).alias("fingerprint"))


def successors(ranged: DataFrame, order: list[str]) -> DataFrame:
    """ranged's distinct rows of the columns of order with next, a struct of the following row's columns, and rows, how
    often they stand in ranged; the last is followed by the first.

    ranged is a written table whose column _range numbers consecutive ranges of order (nulls first).  Each row looks
    for its follower in its own range; a range's last row gets the first row of the next range that has any, from a
    table with one row a range.
    """
    by, row = [F.col(c).asc_nulls_first() for c in order], F.struct(*order)
    others = [F.max(c).alias(c) for c in ranged.columns if c not in (*order, "_range")]
    distinct = ranged.repartition("_range").groupBy("_range", *order).agg(F.count(F.lit(1)).alias("rows"), *others)
    within = distinct.withColumn("_next", F.lead(row).over(Window.partitionBy("_range").orderBy(*by)))
    firsts = ranged.groupBy("_range").agg(F.min(row).alias("_first"))
    every = Window.orderBy("_range")
    firsts = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(every), F.first("_first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    joined = within.join(firsts.select("_range", "_after"), "_range")
    return joined.withColumn("next", F.coalesce("_next", "_after")).drop("_range", "_next", "_after")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by ascending doc_id; after the last comes the first.  Null text is empty.  Null doc_ids come first; rows that
    share a doc_id follow each other by a hash of their texts, and rows with both in common are one document.  A lone document
    follows itself.  An empty docs gives no rows.  Other columns are not read.

    Texts are shuffled once by their key; of each document, its follower's first characters (no more than the edit
    takes) and links are sent to it.
    """
    text, kind = F.coalesce("text", F.lit("")), docs.schema["doc_id"].dataType
    # Keys without nulls, so that joins on them share one exchange.
    key = [F.xxhash64(text).alias("th"), F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)).alias("id"), F.col("doc_id").isNotNull().alias("has")]
    base, order = docs.select(*key, text.alias("text")), ["has", "id", "th"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = docs.select(*key, F.char_length(text).alias("n")).repartitionByRange(parts, *order)
    ranged = written(keys.withColumn("_range", F.spark_partition_id()))
    needs = successors(ranged, order).select("next.th", "next.id", "next.has", F.struct("th", "id", "has").alias("for"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    repeated = ranged.groupBy(*order).count().filter("count > 1").limit(1).count()
    once = base.dropDuplicates(["th", "id", "has"]) if repeated else base
    gift = F.struct(F.substring("text", F.lit(1), F.col("take")).alias("head"), links(F.col("text")).alias("next_links")).alias("gift")
    gifts = needs.join(once, ["th", "id", "has"]).select("for.*", gift)
    both = base.join(gifts, ["th", "id", "has"])
    n = F.char_length("text")
    keep = F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int"))
    out = both.select(F.when(F.col("has"), F.col("id")).alias("doc_id"), n.cast("bigint").alias("n_chars"), F.concat(keep, "gift.head").alias("edited"), "text", F.col("gift.next_links").alias("next_links"))
    chains = F.transform(F.array(F.struct(links(F.col("text")).alias("own"), links(F.col("edited")).alias("edited"), "next_links")), lambda s: F.struct(
        as_text(s["own"]).alias("fingerprint"), as_text(s["edited"]).alias("edited_fingerprint"),
        likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], s["next_links"]).alias("near_next"),
    ))[0].alias("r")
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), chains).select("doc_id", "n_chars", "edited_sha256", "r.*")
