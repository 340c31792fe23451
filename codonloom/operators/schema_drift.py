"""One consistent table from files whose fields drift, and a report of every change."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .components import components

FIELD_TYPE = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("same", pa.string())]))
FIELD_DDL = "array<struct<path: string, kind: string, raw: string, same: string>>"
KINDS = ["number", "text", "boolean", "list"]


def _same(value: object) -> str:
    """Form in which a value is equal to itself in another type."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int | float):
        x = float(value)
        return f"{x:.10g}" if math.isfinite(x) else str(x)
    if isinstance(value, list):
        return "|".join(_same(v) for v in value)
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True, ensure_ascii=False)
    if value is None:
        return ""
    text = str(value).strip()
    low = text.casefold()
    if low in ("true", "false"):
        return "1" if low == "true" else "0"
    if low[:1] in "[" and low[-1:] == "]":
        try:
            return _same(json.loads(text))
        except (ValueError, RecursionError):
            return low
    try:
        return _same(float(text)) if low not in ("nan", "inf", "-inf", "infinity", "-infinity") else low
    except ValueError:
        return low


def _leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str, str, str]]:
    stack = [(prefix, value)]
    while stack:
        head, node = stack.pop()
        for key, v in node.items():
            path = f"{head}.{key}" if head else str(key)
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is None:
                continue
            elif isinstance(v, bool):
                yield path, "boolean", "true" if v else "false", _same(v)
            elif isinstance(v, int | float):
                yield path, "number", repr(v), _same(v)
            elif isinstance(v, list):
                yield path, "list", json.dumps(v, ensure_ascii=False), _same(v)
            else:
                yield path, "text", v, _same(v)


def read_lines(lines: DataFrame, line_col: str = "line", id_field: str = "protein_id") -> DataFrame:
    """``lines`` with ``readable``, ``entity`` (the id field's text) and ``fields``: an entry for
    each non-null leaf with its dotted path, kind, raw text and type-free form.

    A line is readable if it is one JSON object; empty, null, broken and other lines are not.
    """
    keep = [c for c in lines.columns if c != line_col]
    ddl = ", ".join([*(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep), f"readable boolean, entity string, fields {FIELD_DDL}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, who, fields = [], [], []
            for text in batch.column(line_col).to_pylist():
                try:
                    row = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    row = None
                if not isinstance(row, dict):
                    ok.append(False), who.append(None), fields.append([])
                    continue
                ok.append(True)
                leaves = {p: (p, k, r, s) for p, k, r, s in _leaves(row)}
                who.append(leaves[id_field][2] if id_field in leaves else None)
                fields.append([dict(zip(("path", "kind", "raw", "same"), x, strict=True)) for x in leaves.values()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(ok, pa.bool_()), pa.array(who, pa.string()), pa.array(fields, FIELD_TYPE)],
                names=[*keep, "readable", "entity", "fields"],
            )

    return lines.select(*keep, line_col).mapInArrow(run, ddl)


def drift(lines: DataFrame, parsed: DataFrame | None = None, least: float = 0.1, agree: float = 0.8) -> DataFrame:
    """``file_name, change, field, old_field``: every change of a file against the one before it
    (by ``file_seq``) in its feed.

    A file has a field if at least ``least`` of its readable lines hold a non-null value; its
    type is that of most of them (ties: number, text, boolean, list).  A field that is gone and a
    new one are one ``renamed`` field if, over the entities that both files hold with a value, at
    least ``agree`` of the values are the same in whatever type, and each is the other's best
    match; it is ``retyped`` too if the type differs.  Of an entity's repeated lines in a file
    the first counts.  Rows with a null feed or file_seq are left out; files without readable
    lines have no fields; an empty table gives an empty report.
    """
    rows = parsed if parsed is not None else cut(read_lines(lines.select("line_no", "feed", "file_seq", "file_name", "line")))
    rows = rows.filter("feed is not null and file_seq is not null")
    files = rows.groupBy("feed", "file_seq").agg(F.max("file_name").alias("file_name"), F.count_if("readable").alias("n_lines"))
    order = Window.partitionBy("feed").orderBy("file_seq")  # one row a file
    files = cut(files.withColumn("prev_seq", F.lag("file_seq").over(order)).withColumn("next_seq", F.lead("file_seq").over(order)))
    leaves = rows.filter("readable").select("line_no", "feed", "file_seq", "entity", F.explode("fields").alias("f")).select("line_no", "feed", "file_seq", "entity", "f.path", "f.kind", "f.same")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    stats = leaves.groupBy("feed", "file_seq", "path").agg(F.count("*").alias("n"), *kinds)
    top = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when(F.col(k) == top, F.lit(k)) for k in KINDS])
    held = cut(
        stats.join(files, ["feed", "file_seq"])
        .filter(F.col("n") >= F.lit(least) * F.col("n_lines") - 1e-9)
        .select("feed", "file_seq", "prev_seq", "next_seq", "path", kind.alias("kind"))
    )
    now = held.filter("prev_seq is not null").select("feed", "file_seq", "path", F.col("kind").alias("new_kind"))
    old = held.filter("next_seq is not null").select("feed", F.col("next_seq").alias("file_seq"), "path", F.col("kind").alias("old_kind"))
    diff = cut(now.join(old, ["feed", "file_seq", "path"], "full").filter("not new_kind <=> old_kind"))
    came = diff.filter("old_kind is null").select("feed", "file_seq", F.col("path").alias("field"), "new_kind")
    went = diff.filter("new_kind is null").select("feed", "file_seq", F.col("path").alias("old_field"), "old_kind")
    both = came.select("feed", "file_seq").distinct().join(went.select("feed", "file_seq").distinct(), ["feed", "file_seq"])
    seqs = files.select("feed", "file_seq", "prev_seq")

    def values(paths: DataFrame, seq: str, path: str, out: str) -> DataFrame:
        asked = paths.join(both, ["feed", "file_seq"], "left_semi").join(seqs, ["feed", "file_seq"])
        asked = asked.select("feed", F.col("file_seq").alias("at"), F.col(seq).alias("file_seq"), F.col(path).alias("path"))
        got = leaves.filter("entity is not null").join(asked, ["feed", "file_seq", "path"])
        return got.groupBy("feed", "at", "entity", F.col("path").alias(path)).agg(F.min_by("same", "line_no").alias(out))

    pairs = values(came, "file_seq", "field", "new_value").join(values(went, "prev_seq", "old_field", "old_value"), ["feed", "at", "entity"])
    score = pairs.groupBy("feed", "at", "field", "old_field").agg(F.count("*").alias("n"), F.avg((F.col("new_value") == F.col("old_value")).cast("double")).alias("share"))
    good = score.filter(F.col("share") >= agree)
    rank = [F.desc("share"), F.desc("n")]
    by_new = Window.partitionBy("feed", "at", "field").orderBy(*rank, "old_field")
    by_old = Window.partitionBy("feed", "at", "old_field").orderBy(*rank, "field")
    renamed = cut(
        good.withColumn("a", F.row_number().over(by_new)).withColumn("b", F.row_number().over(by_old)).filter("a = 1 and b = 1").select("feed", F.col("at").alias("file_seq"), "field", "old_field")
    )
    same = diff.filter("new_kind is not null and old_kind is not null").select("feed", "file_seq", F.lit("retyped").alias("change"), F.col("path").alias("field"), F.col("path").alias("old_field"))
    new_type = renamed.join(came, ["feed", "file_seq", "field"]).join(went, ["feed", "file_seq", "old_field"]).filter("new_kind <> old_kind")
    out = (
        same.unionByName(renamed.select("feed", "file_seq", F.lit("renamed").alias("change"), "field", "old_field"))
        .unionByName(new_type.select("feed", "file_seq", F.lit("retyped").alias("change"), "field", F.col("field").alias("old_field")))
        .unionByName(came.join(renamed, ["feed", "file_seq", "field"], "left_anti").select("feed", "file_seq", F.lit("added").alias("change"), "field", F.col("field").alias("old_field")))
        .unionByName(went.join(renamed, ["feed", "file_seq", "old_field"], "left_anti").select("feed", "file_seq", F.lit("removed").alias("change"), F.col("old_field").alias("field"), "old_field"))
    )
    return out.join(files.select("feed", "file_seq", "file_name"), ["feed", "file_seq"]).select("file_name", "change", "field", "old_field")


#: Paths that get a column of their own in the consistent table.
MOST_FIELDS = 2000


def field_names(report: DataFrame, parsed: DataFrame, most: int = MOST_FIELDS) -> tuple[dict[str, str], dict[str, str]]:
    """``(path -> column, column -> type)`` of the ``most`` paths with most values (ties: by name).

    Paths joined by renames share the column of the path with most values (ties: first name).
    Its type is ``double`` if most values are numbers, ``boolean`` if booleans, else ``string``
    (lists keep their JSON text).  No more than ``most`` paths reach the driver, whatever keys the
    data hold.
    """
    leaves = parsed.filter("readable").select(F.explode("fields").alias("f"))
    plain_number = F.col("f.same").try_cast("double").isNotNull() if hasattr(F.col("x"), "try_cast") else F.expr("try_cast(f.same as double)").isNotNull()
    stats = leaves.groupBy("f.path").agg(
        F.count("*").alias("n"), F.count_if(F.col("f.kind") == "boolean").alias("booleans"), F.count_if((F.col("f.kind") != "boolean") & plain_number).alias("numbers")
    )
    got = {r["path"]: r for r in stats.orderBy(F.desc("n"), "path").limit(most).collect()}
    group = {p: p for p in got}

    def root(p: str) -> str:
        while group[p] != p:
            group[p] = group[group[p]]
            p = group[p]
        return p

    names = parsed.sparkSession.createDataFrame([(p,) for p in got], "path string")
    renamed = report.filter("change = 'renamed'").select("field", "old_field").distinct()
    for c in ("field", "old_field"):
        renamed = renamed.join(F.broadcast(names), F.col(c) == F.col("path"), "left_semi")  # ``most`` rows at most
    # pairs of ``most`` paths, grouped where they are: each path with the least it was renamed from or to
    linked = components(renamed.select(F.col("field").alias("u"), F.col("old_field").alias("v")))
    for r in linked.collect():  # a row a path
        a, b = root(r["node"]), root(r["comp"])
        if a != b:
            group[max(a, b)] = min(a, b)
    members: dict[str, list[str]] = {}
    for p in got:
        members.setdefault(root(p), []).append(p)
    column, kind = {}, {}
    for paths in members.values():
        name = min(paths, key=lambda p: (-got[p]["n"], p))
        n = sum(got[p]["n"] for p in paths)
        kind[name] = "boolean" if 2 * sum(got[p]["booleans"] for p in paths) > n else "double" if 2 * sum(got[p]["numbers"] for p in paths) > n else "string"
        column |= dict.fromkeys(paths, name)
    return column, kind


def consistent_table(lines: DataFrame, most: int = MOST_FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(table, report, failed)`` of all readable lines.

    table: ``line_no, feed, file_seq, file_name, entity`` and one typed column per field, named
    by its dotted path; renamed paths fill one column.  Paths beyond the ``most`` frequent ones are
    kept as raw text in the map ``other_fields``.  report: see :func:`drift`.  failed:
    ``file_name, field, n_values, n_failed`` - casts of present values that gave no value.
    """
    parsed = cut(read_lines(lines.select("line_no", "feed", "file_seq", "file_name", "line")))
    report = cut(drift(lines, parsed))
    column, kind = field_names(report, parsed, most)
    rows = parsed.filter("readable")
    by_path = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["path"], F.struct(f["raw"], f["same"], f["kind"]))))
    rows = rows.withColumn("m", by_path)
    paths: dict[str, list[str]] = {}
    for p, c in column.items():
        paths.setdefault(c, []).append(p)
    for own in paths.values():
        own.sort()
    value, fails, present = {}, [], []
    for c in sorted(paths):
        picked = F.coalesce(*[F.try_element_at("m", F.lit(p)) for p in paths[c]])
        text = picked["same"]
        # all digits of the raw text; the comparison form, of ten digits, only for what is no plain number
        value[c] = F.coalesce(picked["raw"].try_cast("double"), text.try_cast("double")) if kind[c] == "double" else (text == "1") if kind[c] == "boolean" else picked["raw"]
        if kind[c] == "boolean":
            value[c] = F.when(text.isin("0", "1"), text == "1")
        present.append(F.count(picked).alias(f"n_{len(present)}"))
        fails.append(F.count_if(picked.isNotNull() & value[c].isNull()).alias(f"f_{len(fails)}"))
    names = sorted(paths)
    other = F.map_filter("m", lambda k, _: ~k.isin(*column)) if column else F.col("m")
    other = F.transform_values(other, lambda _, v: v["raw"])
    table = rows.select("line_no", "feed", "file_seq", "file_name", "entity", *[value[c].alias(c) for c in names], other.alias("other_fields"))
    if not names:
        failed = rows.select("file_name", F.lit("").alias("field"), F.lit(0).cast("long").alias("n_values"), F.lit(0).cast("long").alias("n_failed")).limit(0)
        return table, report, failed
    sums = rows.groupBy("file_name").agg(*present, *fails)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("n_values"), F.col(f"f_{i}").alias("n_failed")) for i, c in enumerate(names)])
    failed = sums.select("file_name", F.explode(cells).alias("x")).select("file_name", "x.*").filter("n_values > 0")
    return table, report, failed
