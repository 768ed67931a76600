"""Document fingerprints from closed syncmers, in DataFrame functions only.

Of each k symbols in a row, those count as an anchor whose smallest inner run of s
symbols lies at the first or last place. That depends on the k symbols alone, so equal
passages have equal anchors wherever they stand, and of any k - s + 1 neighbours one is
an anchor. Symbols are words; a text of at most SHORT code points has anchors of code
points as well, as it has too few words. Words of more than LONG_WORD code points, as texts
without spaces have, have anchors of longer runs of code points among those of words, in a text of any length.

Defined results: null text is empty; empty texts have no anchor and are alike to each
other only; fewer than k symbols are one anchor; repeated rows have equal fingerprints;
empty tables give empty results; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS_K, WORDS_S = 8, 2
CHARS_K, CHARS_S = 4, 2
LONG_K, LONG_S, LONG_WORD = 12, 4, 24
SHORT = 400
BUCKET_ROWS, MOST_BUCKETS, STRIDE = 1024, 4096, 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def anchors(symbols: Column, k: int, s: int) -> Column:
    """array<struct<pos int, hash int>>: the closed syncmers of an array of symbols, in order."""
    def found(h: Column) -> Column:
        run = lambda i, n: [F.get(h, i + j) for j in range(n)]
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.hash(h).alias("hash")))

        def closed(g: Column) -> Column:
            inner = k - s + 1
            at = F.filter(
                F.sequence(F.lit(0), F.size(h) - k),
                lambda i: F.least(F.get(g, i), F.get(g, i + inner - 1)) <= _least([F.get(g, i + j) for j in range(1, inner - 1)]),
            )
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.hash(*run(i, k)).alias("hash")))

        runs = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*run(i, s)))
        return F.when(F.size(h) >= k, _let(runs, closed)).when(F.size(h) > 0, whole).otherwise(F.filter(whole, lambda _: F.lit(False)))

    return _let(F.transform(symbols, lambda x: F.xxhash64(x)), found)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def chars(text: Column) -> Column:
    """Code points of a short text; none of a longer one."""
    return F.filter(F.split(F.when(F.length(text) <= SHORT, text).otherwise(""), ""), lambda x: x != "")


def long_words(text: Column) -> Column:
    """Code points of the long words, a space after each."""
    long = F.filter(words(text), lambda w: F.length(w) > LONG_WORD)
    return F.filter(F.split(F.array_join(long, " "), ""), lambda x: x != "")


def with_anchors(df: DataFrame, text: str, prefix: str) -> DataFrame:
    return df.withColumns({
        f"{prefix}_words": F.concat(anchors(words(F.col(text)), WORDS_K, WORDS_S), anchors(long_words(F.col(text)), LONG_K, LONG_S)),
        f"{prefix}_chars": anchors(chars(F.col(text)), CHARS_K, CHARS_S),
    })


def fingerprint(prefix: str) -> Column:
    """The hashes of the anchors in order, eight hex digits each; those of code points after a bar."""
    texts = lambda name: F.array_join(F.transform(F.col(name), lambda a: F.lpad(F.hex(a["hash"].cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")
    return F.concat(texts(f"{prefix}_words"), F.lit("|"), texts(f"{prefix}_chars"))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the anchors' hashes, of words or of code points, whichever is more.
    Two texts without anchors are alike."""
    def jaccard(x: Column, y: Column) -> Column:
        x, y = x["hash"], y["hash"]
        both = F.size(F.array_intersect(x, y))
        return F.coalesce(both / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))

    empty = (F.size(f"{a}_words") == 0) & (F.size(f"{b}_words") == 0)
    found = F.greatest(*[jaccard(F.col(f"{a}_{x}"), F.col(f"{b}_{x}")) for x in ("words", "chars")])
    return F.when(empty, 1.0).otherwise(found)


def _buckets(docs: DataFrame) -> list[int]:
    """Ids at which buckets of neighbours begin, the least first: about BUCKET_ROWS rows in
    each, until their number reaches MOST_BUCKETS and they grow instead."""
    n, least = docs.agg(F.count(F.lit(1)), F.min("_key")).first()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    if count == 1:
        return [] if least is None else [least]
    cuts = docs.agg(F.percentile_approx("_key", [i / count for i in range(1, count)], 20 * count)).first()[0]
    return sorted({least, *cuts})


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors) beside ``next_text`` and its anchors, by ascending id; the
    last document's next is the first.

    Texts are shuffled once, to buckets of neighbouring ids. A bucket's first document also
    goes to the bucket before, to stand after its last.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    )
    cuts = _buckets(keyed) or [0]
    outer, inner = F.lit(cuts[::STRIDE]), F.array(*[F.lit(cuts[i : i + STRIDE]) for i in range(0, len(cuts), STRIDE)])
    reached = lambda values: F.size(F.filter(values, lambda x: x <= F.col("_key"))) - 1
    part = reached(outer)
    own = F.struct((part * STRIDE + reached(F.get(inner, part))).alias("bucket"), F.lit(False).alias("ghost"))
    before = F.struct(
        F.when(F.col("_own.bucket") == 0, len(cuts) - 1).otherwise(F.col("_own.bucket") - 1).alias("bucket"), F.lit(True).alias("ghost")
    )
    starts = F.get(F.get(inner, F.floor(F.col("_own.bucket") / STRIDE).cast("int")), F.col("_own.bucket") % STRIDE) == F.col("_key")
    dealt = (
        keyed.withColumn("_own", own)
        .withColumn("_at", F.explode(F.when(starts, F.array("_own", before)).otherwise(F.array("_own"))))
        .select("doc_id", "text", "_key", F.col("_at.bucket").alias("_bucket"), F.col("_at.ghost").alias("_ghost"))
        .repartition("_bucket")
    )
    lined = Window.partitionBy("_bucket").orderBy("_ghost", "_key", F.xxhash64("text"))
    names = ("text", "own_words", "own_chars")
    ahead = {f"next_{x.removeprefix('own_')}": F.lead(x).over(lined) for x in names}
    return with_anchors(dealt, "text", "own").withColumns(ahead).where(~F.col("_ghost")).drop("_key", "_bucket", "_ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last half the next document's
    beginning replaces, and how like they are."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    both = with_anchors(
        beside_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited), "edited", "edited"
    )
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
