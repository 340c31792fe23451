import random

import pytest

from codonloom.operators import pairs as C
from codonloom.operators import similarity as S


def sets_of(texts, k):
    return [{t[i : i + k] for i in range(len(t) - k + 1)} for t in texts]


def jaccards(rows, k, least):
    s = sets_of([t for _, _, t in rows], k)
    out = {}
    for x, (i, p, _) in enumerate(rows):
        for y, (j, q, _) in enumerate(rows):
            if i < j and p == q and s[x] and s[y] and len(s[x] & s[y]) / len(s[x] | s[y]) >= least:
                out[i, j] = len(s[x] & s[y]) / len(s[x] | s[y])
    return out


def family_rows(letters, n=60):
    rng = random.Random(3)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))) for _ in range(8)]
    texts = [b[rng.randint(0, 6) :] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for b in base for _ in range(n // 8)] + base[:4] * 3 + ["A" * 40, "A" * 50, "AC" * 20, ""]
    return [(i, "pq"[i % 7 == 0], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("letters", ["ACDEFGHIKLMNPQRSTVWY", "AC", "AÄß漢K\U0001f600"])
@pytest.mark.parametrize("k, least", [(3, 0.3), (5, 0.5), (5, 0.8), (12, 0.4)])
def test_jaccard_over_blocks(spark, monkeypatch, letters, k, least):
    """Blocks, their cells and slices of the matches give each pair once with its exact index."""
    from codonloom.operators import kmer_join

    rows = family_rows(letters)
    df = spark.createDataFrame(rows, "id long, part string, txt string")
    monkeypatch.setattr(S, "BLOCK_LETTERS", 500)
    monkeypatch.setattr(S, "EVEN_LETTERS", 300)
    monkeypatch.setattr(S, "MET", 2)
    monkeypatch.setattr(kmer_join, "EXPAND_ROWS", 50)
    got = S.kmer_jaccard(df, k, least).collect()
    want = jaccards(rows, k, least)
    assert len(got) == len(want) and {(r["id_a"], r["id_b"]): r["jaccard"] for r in got} == want and want


def test_kmers_stay_in_their_task(spark):
    """No row for each k-mer is shuffled: the join's plan generates cells, not k-mers (F3, F5-F7, F9)."""
    df = spark.createDataFrame(family_rows("ACDE"), "id long, part string, txt string")
    plan = S.kmer_jaccard(df, 5, 0.5)._jdf.queryExecution().toString()
    assert "mer#" not in plan and "array_distinct" not in plan


def test_audit_and_links_of_repeated_texts(spark):
    rows = [(i, t, s) for i, (_, _, t) in enumerate(family_rows("ACDE")) for s in [random.Random(i).choice(["train", "val", "test", None])]]
    df = spark.createDataFrame(rows, "id long, txt string, split string")
    split = {i: s for i, _, s in rows}
    want = {}
    for (i, j), x in jaccards([(i, "p", t) for i, t, s in rows if s], 5, 0.6).items():
        if split[i] != split[j]:
            n, top = want.get(key := "|".join(sorted((split[i], split[j]))), (0, 0))
            want[key] = n + 1, max(top, x)
    assert {r["splits"]: (r["n_pairs"], r["max_jaccard"]) for r in C.leakage_audit(df, 5, 0.6).collect()} == want and want
    comp = {i: i for i, _, _ in rows}
    near = jaccards([(i, "p", t) for i, t, _ in rows], 5, 0.5)
    for _ in rows:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    got = C.linked_clusters(df, "id", "txt", 5, 0.5).collect()
    assert len(got) == len(rows) and {r["id"]: r["cluster"] for r in got} == comp


def test_round_robin_of_repeated_texts(spark, monkeypatch):
    """Rows of one text are linked as one, so a text joined a thousand times costs no more (F3)."""
    met = []
    monkeypatch.setattr(C, "near_texts", lambda texts, k, least: met.append(texts.count()) or S.near_texts(texts, k, least))
    rows = [(i, ["MKTAYIAKQR", "MKTAYIAKQW", "GGHHLLPPWW"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, txt string")
    got = C.round_robin_splits(C.linked_clusters(df, "id", "txt", 5, 0.5)).collect()
    assert met == [3] and {(r["id"], r["cluster"], r["split"]) for r in got} == {(i, 2 if i % 3 == 2 else 0, "val" if i % 3 == 2 else "train") for i, _ in rows}


def test_blocks_of_a_large_part_are_written_once(spark, monkeypatch):
    """The blocks of a large part are crossed, not copied to each cell through a shuffle (F3, F5)."""
    rows = [(i, t) for i, (_, _, t) in enumerate(family_rows("ACDE"))]
    df = spark.createDataFrame(rows, "id long, txt string")
    monkeypatch.setattr(S, "BLOCK_LETTERS", 300)
    texts, _ = S.text_classes(df.selectExpr("id", "'all' as part", "txt"), 5)
    near = S.near_texts(texts, 5, 0.5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan.split("CartesianProduct")[1]
    want = jaccards([(i, "p", t) for i, t in {t: (i, t) for i, t in reversed(rows)}.values()], 5, 0.5)
    assert {tuple(sorted((r["uid_a"], r["uid_b"]))): r["jaccard"] for r in near.collect()} == want and want


def test_forest_links_what_the_edges_link():
    import numpy as np
    import pyarrow as pa

    from codonloom.operators import kmer_join

    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)]
    low = list(range(301))
    for _ in range(301):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    batches = [pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges[s : s + 20]], pa.int64()) for i in (0, 1)], names=["u", "v"]) for s in range(0, 260, 20)]
    got = [(u, v) for b in kmer_join.forest(30)(iter(batches)) for u, v in zip(*(np.array(c).tolist() for c in b.columns), strict=True)]
    assert sorted(got) == [(i, x) for i, x in enumerate(low) if x != i]
