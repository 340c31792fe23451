"""Queries of the general data problems: drifting files and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hosts import host_key
from ..functions.text_norm import protein_key
from ..operators.fill_missing import time_fill
from ..operators.schema_drift import consistent_table, drift
from .registry import sql_host, sql_protein

#: Days over which a host is carried along its genome's records; beyond, the genome's mode.
HOST_GAP_DAYS = 90.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift(table(spark, d, "feature_lines"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable lines as one typed table (one column per field across its renames)."""
    out, _, _ = consistent_table(table(spark, d, "feature_lines"))
    return out.toDF(*[c.replace(".", "__") for c in out.columns])


def p1_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    _, _, failed = consistent_table(table(spark, d, "feature_lines"))
    return failed


def usable_plddt(c: Column) -> Column:
    return F.when((c > 0) & (c <= 100) & ~F.isnan(c), c)


def usable_depth(c: Column) -> Column:
    return F.when((c >= 1) & ~F.isnan(c) & (c < F.lit(float("inf"))), c)


def plddt_fills(records: DataFrame) -> DataFrame:
    """Filled ``struct_plddt_mean`` cells: ``row_id, value, method, distance_s``."""
    value = usable_plddt(F.try_element_at("extra_features", F.lit("struct_plddt_mean")))
    return time_fill(records, F.col("rec_id"), F.unhex(F.sha2(protein_key("protein_aa"), 256)), F.col("created_at"), value, numeric=True)


def host_fills(records: DataFrame) -> DataFrame:
    return time_fill(records, F.col("rec_id"), F.col("metadata.genome_id"), F.col("created_at"), host_key("host"), numeric=False, gap_days=HOST_GAP_DAYS)


def depth_fills(features: DataFrame) -> DataFrame:
    return time_fill(features, F.col("evo_id"), F.col("protein_id"), F.col("computed_at"), usable_depth(F.col("msa_features.msa_depth")), numeric=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every cell that the time-ordered fill gave a value."""
    records, evo = table(spark, d, "integrated_test_1"), table(spark, d, "evolutionary_features")
    parts = [("integrated_test_1", "struct_plddt_mean", plddt_fills(records)), ("integrated_test_1", "host", host_fills(records)), ("evolutionary_features", "msa_depth", depth_fills(evo))]
    out = None
    for name, field, df in parts:
        one = df.filter("value is not null").select(F.lit(name).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.lit(field).alias("field"))
        out = one if out is None else out.unionByName(one)
    return out


def p4_filled_records(spark: SparkSession, d: str) -> DataFrame:
    """integrated_test_1 with filled pLDDT and host, each with its mark, method and distance."""
    records = table(spark, d, "integrated_test_1")
    plddt = plddt_fills(records).dropDuplicates(["row_id"]).toDF("rec_id", "p_value", "p_method", "p_distance_s")
    host = host_fills(records).dropDuplicates(["row_id"]).toDF("rec_id", "h_value", "h_method", "h_distance_s")
    own = usable_plddt(F.try_element_at("extra_features", F.lit("struct_plddt_mean")))
    base = records.select("rec_id", "protein_id", own.alias("own_plddt"), host_key("host").alias("own_host"))
    return base.join(plddt, "rec_id", "left").join(host, "rec_id", "left").select(
        "rec_id",
        "protein_id",
        F.round(F.coalesce("own_plddt", "p_value"), 6).alias("struct_plddt_mean"),
        F.col("p_method").isNotNull().alias("plddt_filled"),
        F.col("p_method").alias("plddt_method"),
        F.round("p_distance_s", 3).alias("plddt_distance_s"),
        F.coalesce("own_host", "h_value").alias("host"),
        F.col("h_method").isNotNull().alias("host_filled"),
        F.col("h_method").alias("host_method"),
        F.round("h_distance_s", 3).alias("host_distance_s"),
    )


def p4_filled_depths(spark: SparkSession, d: str) -> DataFrame:
    evo = table(spark, d, "evolutionary_features")
    fills = depth_fills(evo).dropDuplicates(["row_id"]).toDF("evo_id", "value", "method", "distance_s")
    return evo.select("evo_id", "protein_id", usable_depth(F.col("msa_features.msa_depth")).alias("own")).join(fills, "evo_id", "left").select(
        "evo_id", "protein_id", F.round(F.coalesce("own", "value"), 6).alias("msa_depth"), F.col("method").isNotNull().alias("filled"), "method", F.round("distance_s", 3).alias("distance_s")
    )


def _lacking(table_name: str, field: str, row: str, group: str, usable: str, source: str) -> str:
    return f"""SELECT '{table_name}' AS table_name, r.id AS row_id, '{field}' AS field FROM (SELECT {row} AS id, {group} AS g, {usable} AS v FROM {source}) r
WHERE r.v IS NULL AND r.g IN (SELECT g FROM (SELECT {group} AS g, {usable} AS v FROM {source}) WHERE g IS NOT NULL AND v IS NOT NULL)"""


PLDDT = "extra_features['struct_plddt_mean']"
DEPTH = "msa_features.msa_depth"
ORACLE: dict[str, str] = {
    "p4_found": " UNION ALL ".join(
        [
            _lacking("integrated_test_1", "struct_plddt_mean", "rec_id", sql_protein("protein_aa"), f"CASE WHEN {PLDDT} > 0 AND {PLDDT} <= 100 AND NOT isnan({PLDDT}) THEN {PLDDT} END", "integrated_test_1"),
            _lacking("integrated_test_1", "host", "rec_id", "metadata.genome_id", sql_host("host"), "integrated_test_1"),
            _lacking("evolutionary_features", "msa_depth", "evo_id", "protein_id", f"CASE WHEN {DEPTH} >= 1 AND isfinite({DEPTH}) THEN {DEPTH} END", "evolutionary_features"),
        ]
    )
}


def _filled(name: str, row: str, group: str, at: str, usable: str, source: str, gap_days: float | None) -> str:
    """CTEs ending in ``{name}(id, value, method, distance_s)``: the fill in SQL.  Without a gap
    numerics are interpolated, with one categories are carried."""
    number = gap_days is None
    best = (
        f"{name}_p AS (SELECT g, tm, avg(v) AS v FROM {name}_b WHERE v IS NOT NULL AND tm IS NOT NULL GROUP BY g, tm), {name}_w AS (SELECT g, avg(v) AS v FROM {name}_b WHERE v IS NOT NULL GROUP BY g)"
        if number
        else f"""{name}_p AS (SELECT g, tm, v FROM (SELECT g, tm, v, count(*) AS k FROM {name}_b WHERE v IS NOT NULL AND tm IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g, tm ORDER BY k DESC, v) = 1),
{name}_w AS (SELECT g, v FROM (SELECT g, v, count(*) AS k FROM {name}_b WHERE v IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, v) = 1)"""
    )
    near = "true" if number else f"least(back, ahead) <= {gap_days * 86_400}"
    whole = "entity_mean" if number else "entity_mode"
    cases = [("pv IS NOT NULL AND nv IS NOT NULL", "pv + (nv - pv) * CASE WHEN back + ahead > 0 THEN back / (back + ahead) ELSE 0 END", "'interpolated'", "least(back, ahead)")] if number else []
    cases += [(f"{near} AND pv IS NOT NULL AND (nv IS NULL OR back <= ahead)", "pv", "'carried_forward'", "back"), (f"{near} AND nv IS NOT NULL", "nv", "'carried_back'", "ahead")]
    pick = lambda i, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {other} END"
    return f"""{name}_b AS (SELECT {row} AS id, {group} AS g, {at} AS tm, {usable} AS v FROM {source} WHERE {group} IS NOT NULL), {best},
{name}_l AS (SELECT b.id, b.g, b.tm, w.v AS whole FROM {name}_b b JOIN {name}_w w ON w.g = b.g WHERE b.v IS NULL), {name}_n AS (SELECT l.id, l.whole, p.v AS pv, q.v AS nv, (epoch_us(l.tm) - epoch_us(p.tm)) / 1e6 AS back, (epoch_us(q.tm) - epoch_us(l.tm)) / 1e6 AS ahead
FROM {name}_l l ASOF LEFT JOIN {name}_p p ON l.g = p.g AND l.tm >= p.tm ASOF LEFT JOIN {name}_p q ON l.g = q.g AND l.tm <= q.tm), {name} AS (SELECT id, {pick(1, 'whole')} AS value, {pick(2, repr(whole))} AS method, {pick(3, 'NULL')} AS distance_s FROM {name}_n)"""


USABLE_PLDDT = f"CASE WHEN {PLDDT} > 0 AND {PLDDT} <= 100 AND NOT isnan({PLDDT}) THEN {PLDDT} END"
USABLE_DEPTH = f"CASE WHEN {DEPTH} >= 1 AND isfinite({DEPTH}) THEN {DEPTH} END"
ORACLE["p4_filled_records"] = f"""WITH {_filled('pl', 'rec_id', sql_protein('protein_aa'), 'created_at', USABLE_PLDDT, 'integrated_test_1', None)}, {_filled('ho', 'rec_id', 'metadata.genome_id', 'created_at', sql_host('host'), 'integrated_test_1', HOST_GAP_DAYS)}
SELECT i.rec_id, i.protein_id, round(coalesce({USABLE_PLDDT}, pl.value), 6) AS struct_plddt_mean, pl.id IS NOT NULL AS plddt_filled, pl.method AS plddt_method, round(pl.distance_s, 3) AS plddt_distance_s, coalesce({sql_host('host')}, ho.value) AS host,
ho.id IS NOT NULL AS host_filled, ho.method AS host_method, round(ho.distance_s, 3) AS host_distance_s FROM integrated_test_1 i LEFT JOIN pl ON pl.id = i.rec_id LEFT JOIN ho ON ho.id = i.rec_id"""
ORACLE["p4_filled_depths"] = f"""WITH {_filled('de', 'evo_id', 'protein_id', 'computed_at', USABLE_DEPTH, 'evolutionary_features', None)}
SELECT e.evo_id, e.protein_id, round(coalesce({USABLE_DEPTH}, de.value), 6) AS msa_depth, de.id IS NOT NULL AS filled, de.method, round(de.distance_s, 3) AS distance_s FROM evolutionary_features e LEFT JOIN de ON de.id = e.evo_id"""


def _same_text(text: str) -> str:
    """A text without its type: numbers in ten digits, truth values as 1 and 0."""
    plain = f"lower(trim({text}))"
    return f"CASE WHEN {plain} IN ('true', 'false') THEN CASE WHEN {plain} = 'true' THEN '1' ELSE '0' END WHEN try_cast({plain} AS DOUBLE) IS NOT NULL AND isfinite(try_cast({plain} AS DOUBLE)) THEN printf('%.10g', try_cast({plain} AS DOUBLE)) ELSE {plain} END"


def _same_list(text: str) -> str:
    return f"array_to_string(list_transform(try_cast({text} AS JSON[]), lambda x: {_same_text('json_extract_string(x, {d})')}), '|')".replace("{d}", "'$'")


ORACLE["p1_found"] = f"""WITH src AS (SELECT line_no, feed, file_seq, file_name, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line::JSON END AS j FROM feature_lines WHERE feed IS NOT NULL AND file_seq IS NOT NULL),
files AS (SELECT feed, file_seq, max(file_name) AS file_name, count(j) AS n_lines FROM src GROUP BY 1, 2), near AS (SELECT *, lag(file_seq) OVER w AS prev, lead(file_seq) OVER w AS next FROM files WINDOW w AS (PARTITION BY feed ORDER BY file_seq)),
nodes AS (SELECT s.line_no, s.feed, s.file_seq, json_extract_string(s.j, '$.protein_id') AS entity, replace(replace(t.fullkey, '$.', ''), '"', '') AS path, t.type, t.value FROM src s, json_tree(s.j) t WHERE s.j IS NOT NULL AND t.type NOT IN ('OBJECT', 'NULL') AND NOT regexp_matches(t.fullkey, '\\[\\d+\\]')),
leaves AS (SELECT *, CASE WHEN type = 'VARCHAR' THEN 'text' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'list' ELSE 'number' END AS kind, json_extract_string(value, '$') AS txt FROM nodes),
vals AS (SELECT line_no, feed, file_seq, entity, path, kind, CASE WHEN kind = 'list' OR (kind = 'text' AND starts_with(trim(txt), '[') AND try_cast(trim(txt) AS JSON[]) IS NOT NULL) THEN {_same_list("trim(txt)")} ELSE {_same_text("txt")} END AS same FROM leaves),
cnt AS (SELECT feed, file_seq, path, count(*) AS n, arg_max(kind, k) AS kind FROM (SELECT feed, file_seq, path, kind, count(*) OVER (PARTITION BY feed, file_seq, path, kind) * 10 - CASE kind WHEN 'number' THEN 0 WHEN 'text' THEN 1 WHEN 'boolean' THEN 2 ELSE 3 END AS k FROM vals) GROUP BY 1, 2, 3),
held AS (SELECT c.feed, c.file_seq, f.prev, f.next, path, kind FROM cnt c JOIN near f USING (feed, file_seq) WHERE n >= 0.1 * n_lines - 1e-9), diff AS (SELECT coalesce(a.feed, b.feed) AS feed, coalesce(a.file_seq, b.next) AS file_seq, coalesce(a.path, b.path) AS path, a.kind AS new_kind, b.kind AS old_kind
FROM (SELECT * FROM held WHERE prev IS NOT NULL) a FULL JOIN (SELECT * FROM held WHERE next IS NOT NULL) b ON a.feed = b.feed AND a.file_seq = b.next AND a.path = b.path WHERE a.kind IS DISTINCT FROM b.kind),
came AS (SELECT feed, file_seq, path AS field, new_kind FROM diff WHERE old_kind IS NULL), went AS (SELECT feed, file_seq, path AS old_field, old_kind FROM diff WHERE new_kind IS NULL),
nv AS (SELECT c.feed, c.file_seq AS tm, v.entity, c.field, arg_min(v.same, v.line_no) AS x FROM came c JOIN vals v ON v.feed = c.feed AND v.file_seq = c.file_seq AND v.path = c.field WHERE v.entity IS NOT NULL GROUP BY ALL),
ov AS (SELECT w.feed, w.file_seq AS tm, v.entity, w.old_field, arg_min(v.same, v.line_no) AS x FROM went w JOIN near f USING (feed, file_seq) JOIN vals v ON v.feed = w.feed AND v.file_seq = f.prev AND v.path = w.old_field WHERE v.entity IS NOT NULL GROUP BY ALL),
score AS (SELECT nv.feed, nv.tm, field, old_field, count(*) AS n, avg((nv.x = ov.x)::INT) AS share FROM nv JOIN ov USING (feed, tm, entity) GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY feed, tm, field ORDER BY share DESC, n DESC, old_field) AS a, row_number() OVER (PARTITION BY feed, tm, old_field ORDER BY share DESC, n DESC, field) AS b FROM score WHERE share >= 0.8),
ren AS (SELECT feed, tm AS file_seq, field, old_field FROM best WHERE a = 1 AND b = 1), found AS (SELECT feed, file_seq, 'retyped' AS change, path AS field, path AS old_field FROM diff WHERE new_kind IS NOT NULL AND old_kind IS NOT NULL UNION ALL SELECT feed, file_seq, 'renamed', field, old_field FROM ren
UNION ALL SELECT r.feed, r.file_seq, 'retyped', r.field, r.field FROM ren r JOIN came c USING (feed, file_seq, field) JOIN went w USING (feed, file_seq, old_field) WHERE c.new_kind <> w.old_kind
UNION ALL SELECT feed, file_seq, 'added', field, field FROM came ANTI JOIN ren USING (feed, file_seq, field) UNION ALL SELECT feed, file_seq, 'removed', old_field, old_field FROM went ANTI JOIN ren USING (feed, file_seq, old_field))
SELECT file_name, change, field, old_field FROM found JOIN files USING (feed, file_seq)"""
