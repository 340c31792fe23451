"""Same or nearly the same records on both sides of a train / evaluation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_norm import protein_key, sequence_key
from ..plans.lineage import cut
from .segjoin import edit_pairs

KINDS = {0: "protein_aa", 1: "sequence"}


def _forms(records: DataFrame, id_col: str, split_col: str, train: str, held: list[str], protein: Column, sequence: Column) -> DataFrame:
    """One row per record and usable text: ``kind, id, held, txt``."""
    side = F.when(F.col(split_col) == train, F.lit(False)).when(F.col(split_col).isin(held), F.lit(True))
    pairs = F.array(F.struct(F.lit(0).alias("kind"), protein.alias("txt")), F.struct(F.lit(1).alias("kind"), sequence.alias("txt")))
    return (
        records.select(F.col(id_col).cast("long").alias("id"), side.alias("held"), pairs.alias("f"))
        .filter("held is not null and id is not null")
        .select("id", "held", F.explode("f").alias("f"))
        .select("f.kind", "id", "held", "f.txt")
        .filter("txt is not null")
    )


def split_overlap(
    records: DataFrame,
    id_col: str = "rec_id",
    split_col: str = "split",
    protein_col: str = "protein_aa",
    sequence_col: str = "sequence",
    train: str = "train",
    held: tuple[str, ...] = ("val", "test"),
    num: int = 1,
    den: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of the overlaps between the training and the evaluation splits.

    members: ``kind, id, held, key`` - every record that takes part, with the class of its text
    (``key`` is the SHA-256 of its normal form).  links: ``kind, key_a, key_b, dist``
    - classes of evaluation texts (a) and training texts (b) within ``num/den`` of the longer
    one's letters; a class on both sides links to itself with distance 0.

    Nulls: a record with a null id, a null split or another split takes no part; a text that is
    null or empty once case, white space and ``*`` are gone matches nothing.  Repeated rows share
    a class.  Ties need no rule: every link is kept.  An empty table gives empty results.  Other
    columns are ignored, whatever their names.
    """
    forms = _forms(records, id_col, split_col, train, list(held), protein_key(protein_col), sequence_key(sequence_col))
    texts = forms.groupBy("kind", "txt").agg(F.min("id").alias("uid"), F.max("held").alias("home"), F.max(~F.col("held")).alias("other"))
    raw = _forms(records, id_col, split_col, train, list(held), F.octet_length(protein_col), F.octet_length(sequence_col))
    sizes = raw.select("kind", F.col("txt").cast("long").alias("n"), F.col("held").alias("home"), (~F.col("held")).alias("other"))
    found = edit_pairs(texts, sizes, num, den, q=6)
    links = cut(found.select("kind", _digest("txt_a").alias("key_a"), _digest("txt_b").alias("key_b"), "dist"))
    members = cut(forms.select("kind", "id", "held", _digest("txt").alias("key")))  # both sides of the pairs read it
    return links, members


def _digest(txt: str) -> Column:
    return F.unhex(F.sha2(txt, 256))


def overlap_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Record pairs ``rec_id_a < rec_id_b``, one of them in training, from classes and links."""
    a = members.filter("held").select("kind", F.col("key").alias("key_a"), F.col("id").alias("x"))
    b = members.filter("not held").select("kind", F.col("key").alias("key_b"), F.col("id").alias("y"))
    pairs = links.select("kind", "key_a", "key_b").join(a, ["kind", "key_a"]).join(b, ["kind", "key_b"])
    return pairs.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")).distinct()


def overlap_report(records: DataFrame, links: DataFrame, members: DataFrame, id_col: str = "rec_id", split_col: str = "split", source_col: str = "source_file") -> DataFrame:
    """Per split and source: records, records with an overlap, and those with an exact one."""
    hit_a = links.groupBy("kind", F.col("key_a").alias("key")).agg(F.min("dist").alias("dist")).withColumn("held", F.lit(True))
    hit_b = links.groupBy("kind", F.col("key_b").alias("key")).agg(F.min("dist").alias("dist")).withColumn("held", F.lit(False))
    hits = members.join(hit_a.unionByName(hit_b), ["kind", "key", "held"]).groupBy("id").agg(F.min("dist").alias("dist"))
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source_file"))
    return (
        rows.join(hits, "id", "left")
        .groupBy("split", "source_file")
        .agg(F.count("*").alias("n_records"), F.count("dist").alias("n_overlap"), F.count_if(F.col("dist") == 0).alias("n_exact"))
    )
