"""A distributed positional inverted index, and the phrases and neighbourhoods found in it.

The index has a posting (term, row, pos) for each occurrence of a term; the term's postings lie side by
side in each file, as each task sorts its own. Documents are read once. Phrases are found by
intersecting lists shifted by the terms' offsets, from the phrase's rarest term on: the rarest term's postings are
candidates for where the phrase starts, the second rarest's postings thin them out, and what is left must meet the
postings of all other terms. Of the index only lists of terms that are asked for are made: a list of
common terms would be as long as the corpus.

DataFrame functions only; no Python runs in a task.

Defined results: null and blank texts have no words, and no phrase is found in them or made of them; phrases
without words are left out; rows that share a doc_id, or have none, are documents of their own; items that
share an id are one item, one without id makes its words hit and is named nowhere; an empty
table of documents gives no rows, one of items leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_mart.llm.common import is_small, joined, ranked, small, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
_SMALL_LETTERS = 1 << 26
_END = ""  # no word; its posting is behind a document's last word


def words_of(text: str) -> Column:
    """Runs of letters, digits and all beyond ASCII, A-Z as lower case."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """``terms`` (word, term) and ``postings`` (term, row, pos), both written; ``documents`` (row, doc_id,
    n_words) has every document, those without a posting as well."""

    terms: DataFrame
    postings: DataFrame
    documents: DataFrame


def index_of(docs: DataFrame, words: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text) for the terms in ``words`` (word)."""
    distinct = words.select("word").where(F.length("word") > 0).distinct()
    terms = ranked(distinct, [], ["word"], "term")
    ended = F.concat(words_of("text"), F.array(F.lit(_END)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", ended.alias("_words"))
    placed = numbered.select("row", "doc_id", F.posexplode("_words").alias("pos", "word"))
    terms = written(terms.unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.lit(-1).cast("long").alias("term"))), "terms")
    letters = terms.agg(F.sum(F.length("word"))).first()[0]
    few = letters <= _SMALL_LETTERS and is_small(terms)
    listed = placed.join(F.broadcast(terms) if few else terms, "word")
    listed = listed.select("term", "row", "pos", F.when(F.col("term") < 0, F.col("doc_id")).alias("doc_id"))
    postings = written(listed.sortWithinPartitions("term", "row", "pos"), "postings")
    ends = postings.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return Index(terms.where("term >= 0"), postings.where("term >= 0").select("term", "row", "pos"), ends)


def _plans(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, size, plan): of each phrase all of whose terms occur, its terms and offsets from the rarest on."""
    counted = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    lists = written(joined(index.terms, counted, ["term"]).select("word", "term", "n"), "lists")
    placed = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    known = placed.join(small(lists), "word")
    plans = known.groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("plan"))
    return written(plans.where(F.size("plan") == F.col("size")), "plans")


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """(row, phrase, start, size) of every occurrence of ``phrases`` (phrase, words), the words in sequence.
    ``phrase`` names one phrase only."""
    plans = _plans(index, phrases)
    step = [F.col("plan")[i] for i in range(2)]

    first = plans.select("phrase", "size", step[0]["term"].alias("term"), step[0]["offset"].alias("offset"))
    found = index.postings.join(small(first), "term").select("row", "phrase", "size", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")

    second = plans.where("size > 1").select("phrase", step[1]["term"].alias("term"), step[1]["offset"].alias("offset"))
    second = written(second, "second")
    asked = joined(found.where("size > 1"), small(second), ["phrase"]).withColumn("pos", F.col("start") + F.col("offset"))
    held = joined(index.postings, small(second.select("term").distinct()), ["term"], "left_semi")
    left = joined(asked, held, ["row", "pos", "term"]).select("row", "phrase", "size", "start")
    left = written(left.unionByName(found.where("size = 1")), "started")

    others = plans.where("size > 2").select("phrase", F.explode(F.slice("plan", 3, F.greatest(F.lit(1), F.col("size") - 2))).alias("of"))
    others = written(others.select("phrase", "of.term", "of.offset"), "others")
    asked = joined(left.where("size > 2"), small(others), ["phrase"]).withColumn("pos", F.col("start") + F.col("offset"))
    rows = written(left.where("size > 2").select("row").distinct(), "rows")
    met = joined(asked, joined(index.postings, small(rows), ["row"], "left_semi"), ["row", "pos", "term"])
    whole = met.groupBy("row", "phrase", "size", "start").agg(F.count(F.lit(1)).alias("_met")).where("_met = size - 2").drop("_met")
    return whole.unionByName(left.where("size <= 2"))


def near_matches(index: Index, pairs: DataFrame, within: int) -> DataFrame:
    """(row, query, left_pos, right_pos): the places where the two words of ``pairs`` (query, left, right) stand at most
    ``within`` words apart, in either order, and not on the same place."""
    names = index.terms
    asked = pairs.join(names.select(F.col("word").alias("left"), F.col("term").alias("left_term")), "left")
    asked = asked.join(names.select(F.col("word").alias("right"), F.col("term").alias("right_term")), "right").select("query", "left_term", "right_term")
    asked = small(written(asked, "pairs"))
    block = F.floor(F.col("pos") / within)
    lefts = joined(index.postings.withColumnRenamed("term", "left_term"), asked, ["left_term"])
    lefts = lefts.select("row", "query", F.col("pos").alias("left_pos"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    rights = joined(index.postings.withColumnRenamed("term", "right_term"), asked, ["right_term"])
    rights = rights.select("row", "query", F.col("pos").alias("right_pos"), block.alias("block"))
    met = joined(lefts, rights, ["row", "query", "block"])
    apart = F.abs(F.col("left_pos") - F.col("right_pos"))
    return met.where((apart > 0) & (apart <= within)).select("row", "query", "left_pos", "right_pos")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (phrase, words) of ``size`` consecutive words, all words of a shorter item being one, and
    (phrase, item_id) of the items that have them."""
    worded = written(items.select("item_id", words_of("text").alias("words")), "item_words").where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    each = worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    each = written(each.withColumn("phrase_words", F.array_join("words", " ")), "windows")
    named = ranked(each.select("phrase_words").distinct(), [], ["phrase_words"], "phrase")
    named = written(named, "phrases")
    owners = joined(each, named, ["phrase_words"]).select("phrase", "item_id").distinct()
    return named.select("phrase", F.split("phrase_words", " ").alias("words")), written(owners, "owners")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): of every document the number of words inside any occurrence of a window of
    the items, and the ids, as sorted strings, of the items that have an occurring window."""
    phrases, owners = windows(items, size)
    index = index_of(docs, phrases.select(F.explode("words").alias("word")))
    found = written(phrase_matches(index, phrases), "matches")

    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.withColumn("_new", F.greatest(F.lit(0), F.col("end") - reached))
    hits = hits.groupBy("row").agg(F.sum("_new").cast("long").alias("n_hit"))

    named = joined(found.select("row", "phrase").distinct(), small(owners), ["phrase"]).select("row", F.col("item_id").cast("string").alias("item"))
    named = named.distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))

    whole = reduce(lambda left, right: joined(left, right, ["row"], "left"), [index.documents, hits, named])
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
