"""How the given tables stand in for sequences, positions and intervals; each frame has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kmers import texts_as_bases
from .registry import table

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
HOUR = 3600


def events(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    df = table(spark, folder, "events")
    df = df.filter(F.col("event_type").isin(*types)) if types else df
    return df.withColumn("pos", F.expr(SECONDS)).withColumn("contig", F.col("user_id"))


def points(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    return events(spark, folder, *types).select(F.col("event_id").alias("point_id"), "contig", "pos", "event_type", "value")


def intervals(spark: SparkSession, folder: str, event_type: str, hours: int) -> DataFrame:
    """An interval of some hours from each event of a type; the strand is the event id's parity."""
    df = events(spark, folder, event_type)
    return df.select(F.col("event_id").cast("string").alias("name"), "contig", F.col("pos").alias("start"), (F.col("pos") + hours * HOUR).alias("end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    return texts_as_bases(table(spark, folder, "documents").select("doc_id", "source", "lang", F.col("text").alias("seq")), "seq")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id").withColumn("score", F.col("n_chars").cast("double"))


def sql_points(*types: str) -> str:
    where = f"where event_type in ({', '.join(repr(t) for t in types)})" if types else ""
    return f"(select event_id as point_id, user_id as contig, epoch_us(ts) // 1000000 as pos, event_type, value from events {where})"


def sql_intervals(event_type: str, hours: int) -> str:
    return (
        f"(select event_id::varchar as name, user_id as contig, epoch_us(ts) // 1000000 as start, epoch_us(ts) // 1000000 + {hours * HOUR} as \"end\", "
        f"case when event_id % 2 = 0 then '+' else '-' end as strand from events where event_type = '{event_type}')"
    )


SQL_SEQUENCES = "(select doc_id, source, lang, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents)"
SQL_LABELLED = "(select doc_id, lang, source, n_chars, quality, toxic, n_chars::double as score from documents join labels using (doc_id))"
