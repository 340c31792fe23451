"""Registration of queries beside the SQL that checks them, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..functions import kernels as K
from ..functions.hosts import HOST_NAMES, host_key
from ..functions.text_norm import protein_key, sequence_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a ``(spark, data_dir) -> DataFrame`` under its name, with its check."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer partitions: the kernels compute far more
    than a shuffle of their input costs.  Larger inputs are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def records(spark: SparkSession, d: str) -> DataFrame:
    """Integrated records in normal form: ``rec_id, protein_id, host, aa, raw, s`` and the rest.

    host: key (E_coli where the spelling names none); raw: sequence; s: without terminal stop."""
    t = table(spark, d, "integrated_test_1")
    return t.withColumns({"host": F.coalesce(host_key("host"), F.lit("E_coli")), "aa": protein_key("protein_aa"), "raw": sequence_key("sequence")}).withColumn("s", K.without_stop(F.col("raw")))


def coding(spark: SparkSession, d: str) -> DataFrame:
    """``rec_id, host, aa, raw, s, cs`` of the records with a sequence; cs: codons of s."""
    return spread(records(spark, d).filter("raw is not null").select("rec_id", "host", "aa", "raw", "s")).withColumn("cs", K.codons(F.col("s")))


# --- SQL -------------------------------------------------------------------------------------

SPACE = r"[\s\x{00A0}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}*]"


def sql_host(c: str) -> str:
    plain = rf"regexp_replace(lower({c}), '[\s\p{{Z}}._\-]+', '', 'g')"
    whens = " ".join(f"WHEN {plain} IN ({', '.join(repr(n) for n in sorted({x.replace(' ', '') for x in names}))}) THEN '{key}'" for key, names in HOST_NAMES.items())
    return f"(CASE {whens} END)"


def sql_protein(c: str) -> str:
    return f"nullif(regexp_replace(upper({c}), '{SPACE}', '', 'g'), '')"


def sql_sequence(c: str) -> str:
    return f"replace({sql_protein(c)}, 'U', 'T')"


RECORDS = f"""rec AS (SELECT * REPLACE (coalesce({sql_host('host')}, 'E_coli') AS host), {sql_protein('protein_aa')} AS aa, {sql_sequence('sequence')} AS raw FROM integrated_test_1),
cds AS (SELECT *, CASE WHEN length(raw) % 3 = 0 AND right(raw, 3) IN ('TAA', 'TAG', 'TGA') THEN left(raw, length(raw) - 3) ELSE raw END AS s FROM rec WHERE raw IS NOT NULL)"""

DIM = "dim(host, codon, aa, w, t, opt, rare, p, u) AS (VALUES " + ", ".join(
    f"('{h}', '{c}', '{f['aa']}', {max(1e-9, f['w'])!r}::DOUBLE, {max(1e-9, f['t'])!r}::DOUBLE, {f['opt']}, {f['rare']}, {f['p']!r}::DOUBLE, {G.usage(h).get(c, 0.0)!r}::DOUBLE)"
    for h in G.HOSTS
    for c, f in G.codon_table(h).items()
) + ")"
PAIRS = "cpb(host, pair, score) AS (VALUES " + ", ".join(f"('{h}', '{p}', {v!r}::DOUBLE)" for h in G.HOSTS for p, v in G.pairs(h).items()) + ")"
CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in G.AA_OF.items()) + ")"
SCALES = "scale(r, kd, dis, hel, she, con, typ) AS (VALUES " + ", ".join(f"('{r}', {', '.join(f'{x!r}::DOUBLE' for x in v.values())})" for r, v in G.SCALES.items()) + ")"

CODONS = """cod AS (SELECT rec_id, host, i, substr(s, 3 * i::INT + 1, 3) AS codon FROM (SELECT rec_id, host, s, unnest(range(length(s) // 3)) AS i FROM cds))"""
FACTS = f"{RECORDS}, {DIM}, {CODONS}, facts AS (SELECT c.*, d.aa, d.w, d.t, d.opt, coalesce(d.rare AND d.aa <> '*', false) AS rare, d.p FROM cod c LEFT JOIN dim d USING (host, codon))"
RESIDUES = f"""{RECORDS}, {SCALES}, prot AS (SELECT rec_id, aa FROM rec WHERE aa IS NOT NULL),
res AS (SELECT rec_id, r, count(*) AS n FROM (SELECT rec_id, unnest(string_split(aa, '')) AS r FROM prot) GROUP BY ALL),
comp AS (SELECT rec_id, sum(n) AS n, count(*) AS kinds, sum(n * coalesce(kd, 0.0)) / sum(n) AS kd, sum(n * coalesce(dis, 0.1)) / sum(n) AS dis, sum(n * coalesce(hel, 1.0)) / sum(n) AS hel, sum(n * coalesce(she, 1.0)) / sum(n) AS she,
  sum(n * coalesce(con, 0.7)) / sum(n) AS con FROM res LEFT JOIN scale USING (r) GROUP BY rec_id),
ent AS (SELECT rec_id, -sum(n / tot * log2(n / tot)) AS h, sum(1 - least(1.0, abs(n / tot - coalesce(typ, 0.05)) / coalesce(typ, 0.05))) / 20 AS sim FROM (SELECT *, sum(n) OVER (PARTITION BY rec_id) AS tot FROM res) LEFT JOIN scale USING (r) GROUP BY rec_id),
base AS (SELECT p.rec_id, p.aa, c.* EXCLUDE (rec_id), e.h, e.sim, (c.kinds / 20.0 + e.h / log2(20)) / 2 AS cx FROM prot p JOIN comp c USING (rec_id) JOIN ent e USING (rec_id))"""
