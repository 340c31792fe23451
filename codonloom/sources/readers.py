"""Readers: tolerant JSON lines, tables by tab, alignments, structures, embeddings, FASTA."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.seeded import seeded
from ..operators.records import last_of, take_lowest
from . import files
from . import schemas as S


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines with a fixed schema.  Tolerant: blank and broken lines are left out; strict: the
    first broken line fails the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    bad = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return rows.filter(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, without repeats, in order of name; missing ones are left out."""
    return sorted({p for p in paths if files.exists(spark, p)})


def discover(spark: SparkSession, inputs: list[str], suffix: str) -> list[str]:
    """Files given by name, by pattern, or in directories (by suffix); each once, sorted."""
    found: set[str] = set()
    for x in inputs:
        found |= set(files.listed(spark, x, suffix)) if files.is_folder(spark, x) else {x} if files.exists(spark, x) else set(files.matching(spark, x))
    return sorted(found)


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    have = existing(spark, paths)
    return read_jsonl(spark, have, schema) if have else spark.createDataFrame([], schema)


def read_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated table with a header; every column text."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def expression_of(text: Column) -> Column:
    """Expression struct from JSON text that is a struct or a bare number."""
    return F.coalesce(
        F.when(F.ltrim(text).startswith("{"), F.from_json(text, S.EXPRESSION)),
        F.struct(text.try_cast("double").alias("value"), *[F.lit(None).cast("string").alias(n) for n in ("unit", "assay", "confidence")], F.lit(None).cast("double").alias("original_value")),
    )


# Names under which a column may come, the first present one counts.
ALIASES = {"protein_id": ["protein_id", "Entry", "id"], "sequence": ["sequence", "RefSeq_nn", "dna"], "protein_aa": ["protein_aa", "RefSeq_aa", "aa"], "host": ["host", "Organism"], "expression": ["expression", "expr"]}


def aliased(rows: DataFrame) -> DataFrame:
    """Canonical columns from whichever aliases the table has; expression defaults to 1.0."""

    def pick(name: str) -> Column:
        have = [F.col(f"`{a}`") for a in ALIASES[name] if a in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    out = {n: pick(n) for n in ALIASES}
    out["expression"] = F.coalesce(out["expression"].try_cast("double"), F.lit(1.0))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def read_tsv_directory(spark: SparkSession, folder: str, cap: int | None = None, reviewed: bool = False) -> DataFrame:
    """All ``*.tsv`` of a folder with their file name; ``cap`` rows a file (the cap is the
    feature; the rows with the smallest content hash of each file)."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("pathGlobFilter", "*.tsv").csv(folder)
    rows = rows.withColumn("source_file", F.col("_metadata.file_name"))
    if reviewed:
        rows = rows.filter(F.lower("Reviewed") == "reviewed")
    if cap is not None:
        cells = [F.col(f"`{c}`") for c in rows.columns]
        rows = take_lowest(rows.withColumn("_t", F.concat_ws("\t", *cells)), ["source_file"], seeded("file", "_t"), ["_t"], F.lit(cap)).drop("_t")
    return rows


def sniff_json(spark: SparkSession, path: str) -> str:
    """``array`` if the first character that is no blank is ``[``, else ``lines``."""
    return "array" if files.first_character(spark, path) == "[" else "lines"


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if sniff_json(spark, path) == "array":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return read_jsonl(spark, path, schema)


def lm_results(rows: DataFrame) -> DataFrame:
    """Language-model results, old and new form: ``position, ok`` and the statistics; failed rows
    keep their position with nulls.  Old form: mean, max, min and population deviation of the
    confidence list."""
    o = F.col("output")
    conf = F.coalesce(o["confidence_scores"], F.array().cast("array<double>"))
    n = F.size(conf)
    m = F.try_divide(F.aggregate(conf, F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    var = F.try_divide(F.aggregate(conf, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), n.cast("double"))
    ok = F.col("status") == "success"
    pos = F.regexp_extract(F.col("metadata.request_id"), r"(\d+)$", 1).try_cast("int")
    keep = lambda c: F.when(ok, c)
    return rows.select(
        pos.alias("position"), ok.alias("ok"), keep(o["avg_loglik"]).alias("evo2_avg_loglik"), keep(o["perplexity"]).alias("evo2_perplexity"), keep(o["geom"]).alias("evo2_geom"),
        keep(F.when(o["perplexity"] > 0, F.log2(o["perplexity"]))).alias("evo2_bpb"), keep(o["avg_loglik"]).alias("evo2_nll"),
        keep(m).alias("evo2_avg_confidence"), keep(F.array_max(conf)).alias("evo2_max_confidence"), keep(F.array_min(conf)).alias("evo2_min_confidence"), keep(F.sqrt(var)).alias("evo2_std_confidence"),
    )


def read_lm_results(spark: SparkSession, path: str) -> DataFrame:
    return lm_results(read_json_any(spark, path, S.LM_RESULT))


def keyed_features(rows: DataFrame) -> DataFrame:
    """Rows with an id and MSA features; of repeated ids the last line wins (column ``line``)."""
    good = rows.filter(F.col("protein_id").isNotNull() & F.col("msa_features").isNotNull())
    return last_of(good, "protein_id", ["line"])


def read_alignment_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Twelve alignment columns without a header; broken lines are left out."""
    return spark.read.schema(S.ALIGNMENT).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: mean and least B-factor of all atoms, and eight statistics over C-alpha atoms."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    v = F.expr("try_cast(trim(substring(value, 61, 6)) as double)")
    atoms = t.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")).withColumn("b", v).filter("b is not null")
    ca = F.when(F.col("value").startswith("ATOM") & (F.trim(F.substring("value", 13, 4)) == "CA"), F.col("b"))
    q = F.percentile(ca, F.lit([0.25, 0.75]))
    out = atoms.groupBy("file").agg(
        F.avg("b").alias("plDDT_mean"), F.min("b").alias("plDDT_min"), F.avg(ca).alias("ca_mean"), F.min(ca).alias("ca_min"), F.max(ca).alias("ca_max"), F.stddev_pop(ca).alias("ca_std"), q.alias("q"),
        F.avg((ca < 70).cast("double")).alias("ca_below70"), F.avg((ca < 50).cast("double")).alias("ca_below50"),
    )
    return out.select("*", F.col("q")[0].alias("ca_q25"), F.col("q")[1].alias("ca_q75")).drop("q")


def read_structure_json(spark: SparkSession, path: str) -> DataFrame:
    """pLDDT statistics and secondary-structure shares of structure JSON files."""
    r = spark.read.schema("plddt array<double>, secondary_structure string").option("multiLine", True).json(path)
    p = F.coalesce("plddt", F.array().cast("array<double>"))
    n = F.size(p).cast("double")
    ss = F.coalesce("secondary_structure", F.lit(""))
    share = lambda c: F.coalesce(F.try_divide(F.regexp_count(ss, F.lit(c)).cast("double"), F.length(ss).cast("double")), F.lit(0.0))
    return r.select(
        F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), n).alias("plddt_mean"), F.array_min(p).alias("plddt_min"), F.array_max(p).alias("plddt_max"), share("H").alias("helix_ratio"), share("E").alias("sheet_ratio"), share("C").alias("coil_ratio")
    )


def read_npz_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """:func:`npz_embeddings` of the files at a path."""
    return npz_embeddings(spark.read.format("binaryFile").load(path).select("path", "content"))


def npz_embeddings(archives: DataFrame) -> DataFrame:
    """``file, dim, l2`` of NPZ embeddings (``path, content``): array ``mean``, else ``emb``, else the first one,
    averaged over its first axis if it has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for b in batches:
            files, dims, norms = [], [], []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    key = next((k for k in ("mean", "emb") if k in z.files), z.files[0] if z.files else None)
                    a = np.asarray(z[key], dtype=float) if key else np.zeros(0)
                a = a.mean(axis=0) if a.ndim == 2 else a.ravel()
                files.append(name.rsplit("/", 1)[-1]), dims.append(int(a.size)), norms.append(float(np.sqrt((a * a).sum())))
            yield pa.RecordBatch.from_pydict({"file": files, "dim": dims, "l2": norms})

    return archives.mapInArrow(run, "file string, dim long, l2 double")


def numeric_json(text: Column) -> Column:
    """Map of the castable values of a flat JSON object."""
    m = F.from_json(text, "map<string,string>")
    return F.map_filter(F.transform_values(m, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def msa_depth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Number of sequences of each FASTA or A3M file."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return t.groupBy("file").agg(F.count_if(F.col("value").startswith(">")).alias("msa_depth"))


def bundle_from_json(text: Column) -> Column:
    return F.from_json(text, S.BUNDLE)


def looked_up(rows: DataFrame, id_col: str, fetch, schema: str, retries: int = 1) -> DataFrame:
    """Rows joined with what ``fetch(id)`` returns (a dict or None), ``retries`` more attempts
    each; failures give nulls.  The hook for external lookups; nothing calls the network here."""
    fields = T.StructType.fromDDL(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key in b.column("id").to_pylist():
                got = None
                for _ in range(retries + 1):
                    try:
                        got = fetch(key)
                        break
                    except Exception:  # noqa: BLE001 - any failed lookup is retried, then null
                        continue
                out.append(got or {})
            cells = [pa.array([x.get(f.name) for x in out], k) for f, k in zip(fields, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cells], names=["id", *(f.name for f in fields)])

    kind = rows.schema[id_col].dataType.simpleString()
    ids = rows.select(F.col(id_col).alias("id")).dropna().distinct()
    got = ids.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
    return rows.join(got, id_col, "left")
