"""Schemas of the record files."""

from pyspark.sql import types as T

TEXT, NUMBER, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def struct(kind: T.DataType, names: str, **more: T.DataType) -> T.StructType:
    """Fields of one kind by name, then those given with their own type."""
    return T.StructType([*(T.StructField(n, kind) for n in names.split()), *(T.StructField(n, k) for n, k in more.items())])


def joined(*parts: T.StructType) -> T.StructType:
    return T.StructType([f for p in parts for f in p.fields])


EXPRESSION = joined(struct(NUMBER, "value"), struct(TEXT, "unit assay confidence"), struct(NUMBER, "original_value"))
METADATA = struct(TEXT, "uniprot_id entry_name protein_names gene_names organism subcellular_location refseq_id genome_id")
MSA = struct(NUMBER, "msa_depth msa_effective_depth msa_coverage conservation_mean conservation_min conservation_max conservation_entropy_mean coevolution_score contact_density pfam_count domain_count")
FEATURES = T.MapType(TEXT, NUMBER)

RECORD = struct(TEXT, "protein_id sequence protein_aa host", expression=EXPRESSION, extra_features=FEATURES, metadata=METADATA)
#: Expression as raw JSON text: a struct or a bare number (see ``readers.expression_of``).
RECORD_LOOSE = struct(TEXT, "protein_id sequence protein_aa host expression", extra_features=FEATURES)
MSA_RECORD = struct(TEXT, "protein_id", msa_features=MSA, line=LONG)
ALIGNMENT = joined(struct(TEXT, "query target"), struct(NUMBER, "pident"), struct(INT, "alnlen mismatch gapopen qstart qend tstart tend"), struct(NUMBER, "evalue bits"))
LM_OUTPUT = joined(struct(TEXT, "sequence"), struct(INT, "sequence_length"), struct(NUMBER, "loglik avg_loglik perplexity geom", confidence_scores=T.ArrayType(NUMBER)))
LM_RESULT = struct(TEXT, "task status", output=LM_OUTPUT, metadata=struct(TEXT, "request_id", processing_time_ms=INT))
BUNDLE = T.StructType(
    [
        *struct(NUMBER, "plDDT_mean plDDT_min").fields, *struct(INT, "tm_segments").fields, *struct(NUMBER, "disorder_fraction").fields, *struct(INT, "esm_emb_dim").fields,
        *struct(NUMBER, "esm_emb_l2 msa_depth conservation_mean").fields, *struct(INT, "length").fields, *struct(NUMBER, "kd_hydropathy_mean").fields,
    ]
)
TASK = struct(TEXT, "task", input=struct(TEXT, "sequence host", forbidden_motifs=T.ArrayType(TEXT)), metadata=struct(TEXT, "request_id"))
UNIPROT = ["Entry", "Reviewed", "Entry Name", "Protein names", "Gene Names", "Organism", "Length", "Subcellular location [CC]", "RefSeq_id", "Genome_id", "RefSeq_nn", "RefSeq_aa"]
