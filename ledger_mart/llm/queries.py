"""Queries over the given tables, one for each operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_mart.llm import html, language, license, mixing, packing, partenum, positional, runs, suffix_tree, syncmers, topk, toxicity, variants
from ledger_mart.llm.common import WORD, held_out, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4)
    scored = toxicity.toxicity(documents, table(spark, sf_dir, "labels"), ~out)
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"), "window")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 4)
    found = language.identified(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


OP4_SQL = """
    with recursive words as (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
        from documents),
    sets as (
        select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
        from words),
    items as (select doc_id, len(s) as n, unnest(s) as x from sets),
    links as (
        select a.doc_id as a, b.doc_id as b
        from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n
        having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach as (
        select doc_id, doc_id as other from sets
        union
        select r.doc_id, l.b from reach r join links l on r.other = l.a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id
    from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)"""


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
    with vectors as (
        select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
        from embeddings
        where vec_id is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
        from vectors q, vectors c
        where q.vec_id % 50 = 0 and c.r <> q.r)
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
    where rank <= 5"""


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 7)
    found = suffix_tree.scored(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
    with sized as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
        from documents),
    totals as (
        select source, cast(sum(size) as bigint) as source_size,
               row_number() over (order by source nulls last) - 1 as turn
        from sized group by source),
    weighed as (
        select *, [3, 1, 2][turn % 3 + 1] as weight, source_size * 2 as cap,
               cast(source_size * 2 as double) / [3, 1, 2][turn % 3 + 1] as stop
        from totals),
    levels as (
        select *, (1.5::double * sum(source_size) over () - (sum(cap) over w - cap)) / sum(weight) over v as level
        from weighed
        window w as (order by stop, turn),
               v as (order by stop, turn rows between current row and unbounded following)),
    firsts as (select *, stop > level as open, min(case when stop > level then [stop, turn, level] end) over () as first from levels),
    targets as (
        select source, source_size, case when open then weight * first[3] else cast(cap as double) end as target
        from firsts),
    lined as (
        select doc_id, size, source_size, target,
               row_number() over (partition by s.source order by size desc, doc_id) - 1 as rank,
               case when source_size > 0 then target / source_size else 0 end as rate,
               cast('0x' || substr(md5('mix:' || coalesce('=' || s.source, 'null')), 1, 8) as bigint) / 4294967296.0::double as shift
        from sized s join targets t on s.source is not distinct from t.source)
    select doc_id, size, source_size, target,
           size * cast(floor(rate * (rank + 1) + shift) - floor(rate * rank + shift) as bigint) as taken
    from lined"""


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose crc32(doc_id) ends in 0, a part repeats from some word on to the end."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = docs.select("doc_id", "text", crc.alias("_h")).withColumn("_g", F.floor(F.col("_h") / 10))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    parted = chosen.withColumn("_words", words).withColumn("_n", F.when(F.size("_words") > 0, F.size("_words")))
    first = F.col("_g") % F.col("_n")
    period = 1 + F.floor((F.col("_n") - F.col("_first")) / (3 + F.col("_g") % 8))
    parted = parted.withColumn("_first", first.cast("int")).withColumn("_period", period.cast("int"))
    rest = F.col("_n") - F.col("_first")
    part = F.slice("_words", F.col("_first") + 1, F.col("_period"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / F.col("_period")).cast("int"))), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_first")), tail), " ")
    return parted.select("doc_id", F.when(F.col("_n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(periodic_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def letter_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of letters with 5 code points or more that occur at least 3 times, one run in 97 without one
    of its code points."""
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    runs_of = F.regexp_extract_all(lower, F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs_of).alias("_run"))
    hashed = each.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = hashed.select(F.when(F.col("_h") % 97 == 0, less).otherwise(F.col("_run")).alias("word")).where(F.length("word") >= 5)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(letter_words(table(spark, sf_dir, "documents")))


def op13_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = """
    with docs as (
        select row_number() over () as r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
        from documents),
    items as (
        select item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
        from benchmark),
    windows as (
        select distinct item_id, least(len(w), 10) as size, unnest(case when len(w) = 0 then [] when len(w) < 10 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) end) as p
        from items),
    lists as (
        select r, size, list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' ')) as ps
        from docs, (select distinct size from windows) where len(w) >= size),
    placed as (select r, size, unnest(ps) as p, generate_subscripts(ps, 1) as i from lists),
    met as (select r, placed.size, i, item_id from placed join windows using (size, p)),
    hit as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + size)) as pos from met) group by r),
    named as (
        select r, count(*) as n_items, string_agg(item, ',' order by item) as ids
        from (select distinct r, cast(item_id as varchar) as item from met) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
    from docs left join hit using (r) left join named using (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license": op1_license,
        "op2_toxicity": op2_toxicity,
        "op3_language": op3_language,
        "op4_partenum": op4_partenum,
        "op5_syncmers": op5_syncmers,
        "op6_topk": op6_topk,
        "op7_suffix_tree": op7_suffix_tree,
        "op8_packing": op8_packing,
        "op9_mixing": op9_mixing,
        "op10_html": op10_html,
        "op11_runs": op11_runs,
        "op12_variants": op12_variants,
        "op13_positional": op13_positional,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_partenum": OP4_SQL,
        "op6_topk": OP6_SQL,
        "op9_mixing": OP9_SQL,
        "op13_positional": OP13_SQL,
    }
