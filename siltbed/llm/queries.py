"""Queries over documents and deliveries: seen keys, leaked test items, source mixture, subject areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import leakage, mixing, seen, subjects


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    oplog = _table(spark, sf_dir, "oplog").where("rec_type in (0, 2) and op_type in (0, 1, 2)")
    return oplog.selectExpr("store_id as grp", "key", "delivery_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.seen_before(_keyed(spark, sf_dir))


def p3_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.error_rate(_keyed(spark, sf_dir)).withColumnRenamed("grp", "store_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item that leaked or came back with other slot values: documents with copies, and with re-parameterised forms."""
    each = leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    copied, moved = F.col("copied") >= leakage.COPIED, F.col("reparameterised") >= leakage.COPIED
    counts = each.groupBy("item_id").agg(F.count_if(copied).alias("copies"), F.count_if(~copied & moved).alias("reparameterised"), F.max("copied").alias("most_copied"))
    return counts.where("copies > 0 or reparameterised > 0")


def p6_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a re-parameterised form of a class of test items, a row a class."""
    return leakage.variants(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(_table(spark, sf_dir, t) for t in ("documents", "subject_samples", "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).where(F.col("share") >= subjects.SHARE).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject: documents that have it, sentences, and its part of all sentences with a subject."""
    each = _subjects(spark, sf_dir)
    per = each.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.SHARE).alias("documents"), F.sum("sentences").alias("sentences"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a subject
    return per.withColumn("share", F.col("sentences") / F.sum("sentences").over(everything))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sources(spark, sf_dir), _table(spark, sf_dir, "source_targets"))


#: The stated budget of p7_budget and p7_capped over the largest without shortages, so that repeats bind and shortages are redistributed.
EXCESS = 1.5


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("post_type").alias("domain"), "lang", "source", "text")


def p7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node of the tree was asked for and given, at a budget that some sources can't meet."""
    return mixing.budget_report(_sources(spark, sf_dir), _table(spark, sf_dir, "source_targets"), EXCESS)


def p7_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached at that budget."""
    documents, targets = _sources(spark, sf_dir), _table(spark, sf_dir, "source_targets")
    _, leaves, wanted = mixing.counted_leaves(documents, targets)
    return mixing.mix(documents, targets, EXCESS * mixing.largest_total(leaves, wanted))[1]


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


QUERIES = {"p3_found": p3_found, "p3_error_rate": p3_error_rate, "p6_found": p6_found, "p6_items": p6_items, "p6_variants": p6_variants, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_budget": p7_budget, "p7_capped": p7_capped, "p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {
    "p3_found": """
WITH rows AS (SELECT store_id, key, delivery_id FROM oplog WHERE rec_type IN (0, 2) AND op_type IN (0, 1, 2)),
first AS (SELECT store_id, key, min(delivery_id) first_id FROM rows GROUP BY store_id, key)
SELECT delivery_id FROM rows JOIN first USING (store_id, key) WHERE delivery_id > first_id""",
    "p3_error_rate": f"""
WITH rows AS (SELECT store_id, key, delivery_id, md5(key)[1:{seen.REPORT_BITS // 4}] h FROM oplog WHERE rec_type IN (0, 2) AND op_type IN (0, 1, 2)),
first AS (SELECT store_id, key, h, min(delivery_id) first_id, count(*) n FROM rows GROUP BY ALL),
judged AS (SELECT *, min(first_id) OVER (PARTITION BY store_id, h) < first_id AS taken_for_seen FROM first)
SELECT store_id, sum(n)::BIGINT AS decisions, (sum(n) - count(*))::BIGINT AS seen, count(*) FILTER (taken_for_seen) AS wrong_by_hash, 0::BIGINT AS wrong,
  count(*) FILTER (taken_for_seen) / sum(n)::DOUBLE AS rate_by_hash
FROM judged GROUP BY store_id""",
}
