"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased. A window is `WINDOW` consecutive words of an
item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

1. Index: one row per posting (document row, position, term), and one row per document row with its id, text hash and number of
   words, in one pass and without a shuffle. Postings lie by document, so the list of a common term is spread over all
   files. A term is the 64-bit hash of a word. `build_index(docs)` has the postings of all words, for any benchmark; given `items`
   it has those of the benchmark's words alone, as the query does, which builds an index for one benchmark. A filter of 8 MB says which these
   are; words beyond them that pass it are indexed too and change nothing, so there is one plan for a benchmark of any size.
2. Terms are counted over the whole index. The two rarest positions of each window are its pivots.
3. Postings of pivots, less their position in the item, are the place where the item would begin in the document.
   A place stays if both pivots of some window meet there. Common terms are never looked at unless a window has no rarer.
4. At each place that stays the item's words within a window of the pivots are looked up in the index, by (document, position, term). Runs of a
   window's length are occurrences. Texts are not read again.
5. Proximity: the postings of an item's rarest term that have all other words of the item within twice its length. The next rarest
   terms are looked up first, the others where these are near.

Words and items are compared by 64-bit hashes: two of n different words have one hash with a chance of about n * n / 2**65, and then count as equal.

Null and empty texts have no words. Items of the same words share one search; null item ids count as the empty
string. Repeated rows of documents each get their result. Empty tables (of either side) give no hits. Extra columns are
carried by `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import drop_rows, hash_filter, table, text_or_empty, with_filter, written

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of an item whose windows are looked through together.
_BLOCK = 4096
#: Words of a block in which positions are looked up for proximity.
_NEAR = 64
_DOCUMENT = " "  # stands for the document among its words; no word has a space


def _parts(text: str) -> Column:
    """The words, with an empty string before and after if the text begins or ends with a separator."""
    return F.split(F.translate(text_or_empty(text), _UPPER, _UPPER.lower()), SEPARATORS)


def words(text: str = "text") -> Column:
    """The words of a text, in order."""
    return F.filter(_parts(text), lambda w: w != "")


class Items:
    """The benchmark's word sequences, written once: `ids` (seq, item_id) and `places` (seq, length, at, term)."""

    def __init__(self, items: DataFrame, key: str = "item_id", text: str = "text"):
        rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), words(text).alias("words")).where(F.size("words") > 0)
        rows = written(rows.withColumn("seq", F.xxhash64(F.array_join("words", " "))), "items")
        self.ids = rows.select("seq", "item_id").distinct()
        places = rows.select("seq", "words").dropDuplicates(["seq"]).select("seq", F.size("words").alias("length"), F.posexplode("words").alias("at", "word"))
        self.places = written(places.select("seq", "length", "at", F.xxhash64("word").alias("term")), "places")


class Index:
    """`postings` (doc, pos, term), `documents` (doc, id, th, n_words) and `counts` (term, n), all written."""

    def __init__(self, stored: DataFrame):
        is_document = F.col("id_").isNotNull()
        self.postings = stored.where(~is_document).select("doc", "pos", "term")
        self.documents = stored.where(is_document).select("doc", F.col("id_.id").alias("id"), F.col("id_.th").alias("th"), F.col("pos").cast("long").alias("n_words"))
        self.counts = written(self.postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def build_index(docs: DataFrame, items: Items | None = None, *, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all words, or of those that pass a filter of the words of `items`: all of theirs, and few others while the filter has room."""
    identity = F.struct(F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"))
    parts = docs.select(F.monotonically_increasing_id().alias("doc"), identity.alias("identity"), _parts(text).alias("parts"))
    lead = (F.col("parts")[0] == "").cast("int")
    trail = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    parts = parts.withColumns({"lead": lead, "n": F.size("parts") - lead - trail})
    each = parts.select("doc", "identity", "lead", "n", F.posexplode(F.concat("parts", F.array(F.lit(_DOCUMENT)))).alias("at", "word")).where("word <> ''").withColumn("term", F.xxhash64("word"))
    is_document = F.col("word") == _DOCUMENT
    if items is not None:
        each = with_filter(each, "term", hash_filter(items.places.select("term").distinct(), "term"), "wanted").where(F.col("wanted") | is_document)
    return Index(
        written(
            each.select("doc", F.when(is_document, F.col("n")).otherwise(F.col("at") - F.col("lead")).alias("pos"), "term", F.when(is_document, F.col("identity")).alias("id_")),
            "postings",
        )
    )


def pivots(items: Items, index: Index, window: int = WINDOW) -> DataFrame:
    """(seq, p, q): the rarest and second rarest position of each window; (p, p) in windows of one word.

    Items are cut into blocks of `_BLOCK` places that go on by a window, so no row or group grows with an item.
    """
    block = F.floor(F.col("at") / _BLOCK)
    both = F.when((F.col("at") % _BLOCK < window - 1) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))
    placed = items.places.join(index.counts, "term", "left").select("seq", "at", "length", F.coalesce("n", F.lit(0)).alias("n"), F.explode(both).alias("block"))
    ahead = Window.partitionBy("seq", "block").orderBy("at").rowsBetween(0, window - 1)
    starts = placed.withColumn("r", F.array_sort(F.collect_list(F.struct("n", "at")).over(ahead))).where(block == F.col("block")).where(F.col("at") + F.least("length", F.lit(window)) <= F.col("length"))
    two = starts.select("seq", "r").where("r[0].n > 0")  # a term without postings has no occurrence
    return two.select("seq", F.col("r")[0]["at"].alias("p"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])["at"].alias("q")).distinct()


def _postings_of(index: Index, rows: DataFrame) -> DataFrame:
    """Postings of the terms of the written rows, joined with them; a filter of 8 MB comes first, so the rest is not moved."""
    some = with_filter(index.postings, "term", hash_filter(rows, "term"), "maybe").where("maybe").drop("maybe")
    return some.join(rows, "term")


def places(items: Items, index: Index, *, window: int = WINDOW) -> DataFrame:
    """(doc, seq, begin, p, q): where both pivots of a window of the item meet; begin may be negative."""
    pairs = written(pivots(items, index, window), "pivots")
    ends = pairs.select("seq", F.col("p").alias("at")).union(pairs.select("seq", F.col("q").alias("at"))).distinct()
    ends = written(ends.join(items.places.select("seq", "at", "term"), ["seq", "at"]), "pivot-terms")
    met = written(_postings_of(index, ends).select("doc", "seq", (F.col("pos") - F.col("at")).alias("begin"), "at"), "met")
    first = met.withColumnRenamed("at", "p").join(pairs, ["seq", "p"])
    return first.join(met.withColumnRenamed("at", "q"), ["doc", "seq", "begin", "q"], "left_semi").select("doc", "seq", "begin", "p", "q")


def phrase_matches(items: Items, index: Index, *, window: int = WINDOW) -> DataFrame:
    """(doc, seq, begin, since, till): runs of at least a window's length of an item's words at a place in a document row, and the positions
    from `since` to `till` that they take there.

    A window has both its pivots, so only words within its length of them are looked up.
    """
    found = places(items, index, window=window)
    near = F.sequence(F.greatest("p", "q") - window + 1, F.least("p", "q") + window - 1)
    wanted = found.select("doc", "seq", "begin", F.explode(near).alias("at")).distinct().join(items.places, ["seq", "at"])
    wanted = wanted.select("doc", (F.col("begin") + F.col("at")).alias("pos"), "term", "seq", "begin", "at", "length")
    wanted = written(wanted.withColumn("h", F.xxhash64("doc", "pos", "term")), "wanted")
    have = with_filter(index.postings.withColumn("h", F.xxhash64("doc", "pos", "term")), "h", hash_filter(wanted, "h"), "maybe").where("maybe").select("doc", "pos", "term")
    same = have.join(wanted.drop("h"), ["doc", "pos", "term"])
    run = F.col("at") - F.row_number().over(Window.partitionBy("doc", "seq", "begin").orderBy("at"))
    runs = same.withColumn("run", run).groupBy("doc", "seq", "begin", "run").agg(F.min("pos").alias("since"), F.max("pos").alias("till"), F.max("length").alias("length"))
    return runs.where(F.col("till") - F.col("since") + 1 >= F.least("length", F.lit(window))).select("doc", "seq", "begin", "since", "till")


def proximity_matches(items: Items, index: Index, *, reach: Column | None = None, terms: int = 3) -> DataFrame:
    """(doc, seq, pos): postings of an item's rarest term that have all words of the item within `reach` words.

    reach: a column over `length`, the item's number of words; twice that if none is given. The `terms` rarest terms are looked up
    first, by document, item and block of positions, the others where those are near. Items with a word that no document has give none.
    """
    reach = F.col("length") * 2 if reach is None else reach
    known = items.places.groupBy("seq", "term").agg(F.first(reach.cast("int")).alias("reach")).join(index.counts, "term", "left")
    rank = Window.partitionBy("seq").orderBy("n", "term")
    whole = Window.partitionBy("seq")
    known = known.withColumns({"rank": F.row_number().over(rank), "of": F.count("*").over(whole), "least": F.min(F.coalesce("n", F.lit(0))).over(whole)}).where("least > 0")
    known = written(known.select("seq", "term", "reach", "rank", "of"), "ranked")
    rare = known.where(F.col("rank") <= terms)
    found = _postings_of(index, rare).select("doc", "seq", "pos", "rank", "reach", F.least("of", F.lit(terms)).alias("of"), F.floor(F.col("pos") / F.col("reach")).alias("block"))
    found = written(found, "rare-postings")
    first = found.where("rank = 1").select("doc", "seq", "pos", "reach", "of", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    other = found.where("rank > 1").select("doc", "seq", F.col("pos").alias("other"), "rank", "block")
    near = first.join(other, ["doc", "seq", "block"], "left").where(F.col("other").isNull() | (F.abs(F.col("other") - F.col("pos")) <= F.col("reach")))
    near = near.groupBy("doc", "seq", "pos", "reach").agg(F.countDistinct("rank").alias("ranks"), F.max("of").alias("of")).where("ranks = of - 1")
    block = lambda c: F.floor(c / _NEAR).cast("long")
    blocks = F.sequence(block(F.col("center") - F.col("reach")), block(F.col("center") + F.col("reach")))
    near = near.select("doc", "seq", F.col("pos").alias("center"), "reach").join(known.groupBy("seq").agg(F.max("of").alias("of")), "seq")
    wanted = written(near.select("doc", "seq", "center", "reach", "of", F.explode(blocks).alias("block")).withColumn("h", F.xxhash64("doc", "block")), "wanted-near")
    have = index.postings.withColumn("block", block(F.col("pos")))
    have = with_filter(have.withColumn("h", F.xxhash64("doc", "block")), "h", hash_filter(wanted, "h"), "maybe").where("maybe").select("doc", "block", "pos", "term")
    met = have.join(wanted.drop("h"), ["doc", "block"]).where(F.abs(F.col("pos") - F.col("center")) <= F.col("reach"))
    met = met.join(known.select("seq", "term"), ["seq", "term"]).groupBy("doc", "seq", "center").agg(F.countDistinct("term").alias("met"), F.max("of").alias("of")).where("met = of")
    return met.select("doc", "seq", F.col("center").alias("pos"))


def _results(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int, proximity: bool) -> DataFrame:
    items = Items(benchmark, item_key, item_text)
    index = build_index(docs, items, key=key, text=text)
    hits = written(phrase_matches(items, index, window=window), "hits")
    n_hit = hits.select("doc", F.explode(F.sequence("since", "till")).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    names = hits.select("doc", "seq").distinct().join(items.ids, "seq").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = n_hit.join(names, "doc")
    if proximity:
        near = proximity_matches(items, index).select("doc", "seq").distinct().join(items.ids, "seq").groupBy("doc").agg(F.countDistinct("item_id").alias("n_near"))
        found = found.join(near, "doc", "full")
    else:
        found = found.withColumn("n_near", F.lit(0))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return index.documents.join(found, "doc", "left").select("id", "th", "n_words", count("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), count("n_near"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, items (sorted ids of the items that occur), n_near (items that are near)."""
    found = _results(docs, benchmark, key, text, item_key, item_text, window, True)
    return found.select(F.col("id").alias(key), "n_words", "n_hit", "items", "n_near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    found = _results(docs, benchmark, key, text, item_key, item_text, window, False)
    goes = written(found.where("n_hit > 0").select("id", "th", F.lit(False).alias("one")).distinct(), "contaminated")
    return drop_rows(docs, goes, F.col(key), text)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of `benchmark` in `documents`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near (items by proximity)."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )
