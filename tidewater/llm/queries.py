"""Queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import leakage, packing, spans
from tidewater.session import settle
from tidewater.sources.tables import table


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Where every document's tokens lie in containers of 2048."""
    return packing.pack(table(spark, d, "documents"), doc_id="doc_id", text="text", source="source", capacity=2048)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and documents of each container."""
    return p8_packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.countDistinct("source").alias("sources"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """What each source has in each window."""
    return packing.mixture(p8_packed(spark, d))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers over the capacity, documents split that needn't be, and documents whose parts
    aren't all of their tokens from the first on."""
    packed = settle(p8_packed(spark, d))
    room = packed.groupBy("container").agg(F.sum("tokens").alias("n"))
    parts = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.countDistinct("first_token").alias("starts"))
    of_docs = parts.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("parts > 1 and n <= 2048")).alias("split"), F.count_if(F.expr("end <> n or starts <> parts")).alias("torn"))
    return of_docs.crossJoin(room.agg(F.count_if(F.expr("n > 2048")).alias("overfull")))  # one row each


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all aligned pairs, edited copies among them."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="text")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an edited copy of an item, though no 12 of its words in a row."""
    return leakage.edited_copies(p9_alignments(spark, d)).select("doc_id", "item_id", "score")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_alignments(spark, d).where("longest_run >= 12").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"), doc_id="doc_id", text="text")


def p10_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the sets that it shares spans in, and a set's representative, its lowest id: the pairs of
    `p10_found` without expanding them. Documents with one text have the same sets."""
    member = spans.sharing_sets(table(spark, d, "documents"), doc_id="doc_id", text="text")
    first = member.groupBy("members", "d1", "d2").agg(F.min("doc_id").alias("representative"))
    return member.join(first, ["members", "d1", "d2"]).select("doc_id", "representative", "members").distinct()


def p10_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each document's intervals that stand elsewhere too, with the part of the text that they cover."""
    docs = table(spark, d, "documents")
    cut = spans.shared_intervals(docs, doc_id="doc_id", text="text")
    return cut.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").withColumn("part", F.round(F.col("shared") / F.col("n"), 6)).drop("n")


QUERIES = {f.__name__: f for f in (p8_packed, p8_fill, p8_mixture, p8_invariants, p9_found, p9_alignments, p9_edited, p10_found, p10_sets, p10_intervals)}
#: Characters that show nothing, as in `leakage.INVISIBLE`.
_UNSEEN = r"[\x{00ad}\x{034f}\x{061c}\x{115f}-\x{1160}\x{17b4}-\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}]"


def _runs_sql(table: str, key: str) -> str:
    """Runs of 12 words of each text of a table."""
    words = rf"regexp_extract_all(replace(lower(nfc_normalize(regexp_replace(text, '{_UNSEEN}', '', 'g'))), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"
    return f"select {key}, array_to_string(list_slice(w, k, k + 11), ' ') as g from (select {key}, {words} as w from {table} where text is not null and {key} is not null), lateral (select unnest(range(1, len(w) - 10)) as k)"


#: Scores of alignments and packings aren't given in SQL; those queries are tested against brute force.
SQL: dict[str, str] = {
    "p8_invariants": "select count(*) as documents, 0 as split, 0 as torn, 0 as overfull from documents where doc_id is not null and length(text) > 0",
    "p10_sets": """
      with w as (select doc_id, hash(substring(text, k::bigint, 300)) as h from documents, lateral (select unnest(range(1, length(text) - 298)) as k) where length(text) >= 300 and doc_id is not null),
      s as (select distinct list_sort(list(distinct doc_id)) as d from w group by h having count(distinct doc_id) > 1)
      select distinct unnest(d) as doc_id, d[1] as representative, len(d) as members from s""",
    "p10_intervals": """
      with w as (select doc_id, length(text) as n, k, hash(substring(text, k::bigint, 300)) as h from documents, lateral (select unnest(range(1, length(text) - 298)) as k) where length(text) >= 300 and doc_id is not null),
      s as (select w.* from w semi join (select h from w group by h having count(distinct doc_id) > 1) x on x.h = w.h),
      b as (select *, case when k - lag(k) over o > 300 then 1 else 0 end as new from s window o as (partition by doc_id order by k)),
      i as (select doc_id, any_value(n) as n, min(k) - 1 as first, max(k) + 299 as last from (select *, sum(new) over (partition by doc_id order by k) as g from b) group by doc_id, g)
      select doc_id, first, last, count(*) over (partition by doc_id) as n_spans, sum(last - first) over (partition by doc_id) as shared, round(sum(last - first) over (partition by doc_id) / n, 6) as part from i""",
    "p10_found": """
      with w as (select doc_id, hash(substring(text, k::bigint, 300)) as h from documents, lateral (select unnest(range(1, length(text) - 298)) as k) where length(text) >= 300 and doc_id is not null),
      s as (select distinct list(distinct doc_id) as d from (select doc_id, h from w) group by h having count(distinct doc_id) > 1)
      select distinct a as doc_a, b as doc_b from (select d, unnest(d) as a from s), lateral (select unnest(d) as b) where a < b""",
    "p9_found": f"with d as ({_runs_sql('documents', 'doc_id')}), i as ({_runs_sql('eval_items', 'item_id')}) select distinct doc_id, item_id from d join i using (g)",
}
