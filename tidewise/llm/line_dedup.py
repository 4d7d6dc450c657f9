"""Line dedup by distinct-site spread, with DataFrame functions only.

Each line has a HyperLogLog sketch of the sites it stands on; partial sketches merge by
aggregation. Lines whose estimate is clearly above the threshold are boilerplate, those
near it get exact distinct counts, the rest stays. A long line is not repeated by chance, so its threshold is
lower than that of a short one. Boilerplate is removed from every
document but the one with the smallest id, so no passage vanishes from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm.common import look_up, read, saved

MIN_SITES = 5
#: A line of so many words is boilerplate from so many sites on.
LONG_WORDS, LONG_SITES = 50, 2
#: Sketches have 2**LOG_K buckets: a relative error of about 3 %.
LOG_K = 10
#: Estimates within this share of the threshold are counted exactly (six times the error).
NEAR = 0.2


def line_key(line: Column) -> Column:
    """128-bit digest of a line without outer blanks, in lower case."""
    return F.unhex(F.md5(F.lower(F.btrim(line, F.lit(" \t\r"))).cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def is_long(line: Column, words: int) -> Column:
    """Whether the line has so many words between blanks; a line of fewer characters than they need is not split."""
    plain = F.btrim(line, F.lit(" \t\r"))
    return F.when(F.length(plain) >= 2 * words - 1, F.size(F.split(plain, "[ \t\r]+")) >= words).otherwise(False)


def boilerplate(lines: DataFrame, min_sites: int, long_sites: int) -> DataFrame:
    """(h, n, first_doc) of the lines on enough sites, from (doc_id, site, h, long) rows."""
    spread = saved(
        lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"),
                               F.min("doc_id").alias("first_doc"), F.max("long").alias("long"))
        .select("h", "n", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"),
                F.when(F.col("long"), long_sites).otherwise(min_sites).alias("need"))
        .filter(F.col("sites") >= (1 - NEAR) * F.col("need")), "spread")
    clear = F.col("sites") > (1 + NEAR) * F.col("need")
    near = spread.filter(~clear)
    counted = (look_up(lines.select("h", "site"), "h", near.select("h", "n", "need"), "n", "near").filter("n is not null")
               .select("h", "site", "need").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("exact"), F.first("need").alias("need"))
               .filter(F.col("exact") >= F.col("need")))
    return spread.filter(clear).unionByName(near.join(counted.select("h"), "h", "left_semi")).select("h", "n", "first_doc")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
               min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``n_lines``, ``n_removed``.

    Boilerplate stands on at least ``min_sites`` sites, or, if it has ``long_words`` words or more, on ``long_sites``. Blank lines are never boilerplate. A null site is one site of its own. A null text
    stays null and has no lines; a text may become empty, its row stays. A null doc_id keeps a
    line only if no document with an id has it; rows of one doc_id are treated alike, each
    with its own text. Input columns named like an output column are replaced. A text is one row, so memory holds the longest.
    """
    exploded = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"),
                           F.explode(_lines(F.col(f"`{text}`"))).alias("line"))
    lines = saved(exploded.filter(F.btrim("line", F.lit(" \t\r")) != "").select(
        "doc_id", "site", line_key(F.col("line")).alias("h"), is_long(F.col("line"), long_words).alias("long")), "lines")
    known = saved(boilerplate(lines, min_sites, long_sites), "boilerplate")
    found = look_up(lines.select("doc_id", "h"), "h", known, "n", "found").filter("n is not null")
    gone = (found.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
            .groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("h").alias("__gone")))

    body = docs.drop("n_lines", "n_removed")
    joined = body.join(gone, body[f"`{doc_id}`"].eqNullSafe(F.col("__doc")), "left")
    all_lines = _lines(F.col(f"`{text}`"))
    left = F.filter(all_lines, lambda x: ~F.array_contains(F.col("__gone"), line_key(x)))
    changed = F.col("__gone").isNotNull() & F.col(f"`{text}`").isNotNull()
    joined = joined.withColumn("__left", F.when(changed, left))
    n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    out = joined.select("*", n.alias("n_lines"), F.coalesce(n - F.size("__left"), F.lit(0)).cast("long").alias("n_removed"))
    out = out.withColumn(text, F.when(F.col("__left").isNull(), F.col(f"`{text}`")).otherwise(F.array_join("__left", "\n")))
    return out.drop("__doc", "__gone", "__left")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP7_SQL = f"""
with lines as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
keyed as (select *, lower(trim(line, chr(32) || chr(9) || chr(13))) as k from lines),
boiler as (
  select k, min(doc_id) as first_doc from keyed where k <> ''
  group by k having count(distinct site) >= case when len(regexp_split_to_array(k, '[ \t\r]+')) >= {LONG_WORDS} then {LONG_SITES} else {MIN_SITES} end),
marked as (
  select l.*, b.k is not null and l.doc_id is distinct from b.first_doc as gone
  from keyed l left join boiler b on l.k = b.k)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text,
       count(*) as n_lines, count(*) filter (gone) as n_removed
from marked group by doc_id
union all select doc_id, null, 0, 0 from documents where text is null
"""
