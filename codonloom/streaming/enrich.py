"""Structured Streaming: record enrichment and task files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.hosts import host_key
from ..functions.text_norm import sequence_key
from ..sources.schemas import RECORD, TASK


def enriched(rows: DataFrame) -> DataFrame:
    """Stateless codon features of records, for batches and streams alike."""
    r = rows.withColumns({"s": K.without_stop(sequence_key("sequence")), "h": F.coalesce(host_key("host"), F.lit("E_coli"))}).withColumn("cs", K.codons(F.col("s")))
    r = r.withColumn("f", K.codon_facts(F.col("cs"), F.col("h")))
    ok = K.validate_cds(F.col("s")) == "OK"
    f = F.col("f")
    return r.withColumns({"codon_gc": K.gc(F.col("s")), "codon_cai": F.when(ok, K.cai(f)), "codon_tai": F.when(ok, K.tai(f)), "codon_fop": F.when(ok, K.fop(f))}).drop("s", "h", "cs", "f")


def enrich_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType = RECORD, files_per_trigger: int = 100):
    """JSON-lines files of a folder, enriched as they arrive; the checkpoint resumes a stopped
    run where it was.  Broken lines are left out.  Returns the started query."""
    bad = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    raw = spark.readStream.schema(wide).option("columnNameOfCorruptRecord", bad).option("maxFilesPerTrigger", files_per_trigger).json(source)
    out = enriched(raw.filter(F.col(bad).isNull()).drop(bad))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_results(tasks: DataFrame) -> DataFrame:
    """Analyser envelopes: ``request_id, status, metrics, error``; an unreadable or invalid
    sequence is an error row, never a failure."""
    r = tasks.withColumn("s", K.dna(F.col("input.sequence"))).withColumn("h", F.coalesce(host_key("input.host"), F.lit("E_coli")))
    r = r.withColumn("cs", K.codons(F.col("s"))).withColumn("f", K.codon_facts(F.col("cs"), F.col("h"))).withColumn("check", F.coalesce(K.validate_cds(F.col("s")), F.lit("No sequence.")))
    ok = F.col("check") == "OK"
    metrics = F.struct(F.length("s").alias("length"), K.gc(F.col("s")).alias("gc"), K.cai(F.col("f")).alias("cai"), K.fop(F.col("f")).alias("fop"))
    hits = F.coalesce(F.aggregate("input.forbidden_motifs", F.lit(0), lambda a, m: a + F.regexp_count(F.col("s"), F.concat(F.lit("(?="), m, F.lit(")")))), F.lit(0))
    status = F.when(~ok, "error").when(hits > 0, "warning").otherwise("success")
    return r.select(F.col("metadata.request_id").alias("request_id"), "task", status.alias("status"), F.when(ok, metrics).alias("metrics"), hits.alias("forbidden_sites"), F.when(~ok, F.col("check")).alias("error"))


def task_stream(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Task files in, result files out."""
    tasks = spark.readStream.schema(TASK).option("multiLine", True).json(source)
    return task_results(tasks).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
