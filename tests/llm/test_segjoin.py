"""Segment join, split overlaps and density clusters against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonloom.llm import density_clusters, segjoin
from codonloom.llm.density_clusters import cluster_links, cluster_pairs, describe_clusters, similarity_clusters
from codonloom.llm.segjoin import Pack, distances, edit_pairs
from codonloom.llm.split_overlap import overlap_pairs, overlap_report, split_overlap


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, s, n, letters):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        what = rng.random()
        if what < 0.34:
            s.insert(at, rng.choice(letters))
        elif s and what < 0.67:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


def family_texts(rng, letters, n, low, high, most):
    out = []
    while len(out) < n:
        base = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        out.append(base)
        for _ in range(rng.randint(0, 4)):
            out.append(edited(rng, base, rng.randint(0, int(len(base) * most) + 1), letters))
    return list(dict.fromkeys(t for t in out[:n] if t))


def near(a, b, num, den):
    return distance(a, b) <= max(len(a), len(b)) * num // den


@pytest.mark.parametrize("num,den,letters,low,high,q", [(1, 10, "ACGT", 1, 120, 6), (1, 4, "ACDEFGHIKLMNPQRSTVWY", 1, 60, 3), (1, 4, "AB", 1, 25, 3), (1, 10, "aé中", 5, 60, 6), (2, 5, "ABCD", 1, 30, 2)])
def test_self_join_is_exact(spark, num, den, letters, low, high, q):
    rng = random.Random(low * 7 + high + den)
    texts = family_texts(rng, letters, 130, low, high, num / den)
    rows = [(0, i, t, True, True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "kind int, uid long, txt string, home boolean, other boolean")
    sizes = df.select("kind", F.length("txt").cast("long").alias("n"), "home", "other")
    # small blocks and chunks: every path of the blocking is taken
    got = edit_pairs(df, sizes, num, den, q, dims=512, same=True, home_letters=700, other_letters=(900, 900), chunk_letters=300, chunk_rows=7).collect()
    aligned = edit_pairs(df, sizes, num, den, q, dims=512, same=True, align=True, home_letters=1500, chunk_letters=900).collect()
    assert {(r["uid_a"], r["uid_b"], r["dist"]) for r in aligned} == {(r["uid_a"], r["uid_b"], r["dist"]) for r in got}
    seen = [frozenset((r["uid_a"], r["uid_b"])) for r in got]
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if near(texts[i], texts[j], num, den)}
    assert len(seen) == len(set(seen)) and set(seen) == want
    assert all(r["dist"] == distance(texts[r["uid_a"]], texts[r["uid_b"]]) for r in got[:40])


def test_alignment(monkeypatch):
    rng = random.Random(4)
    a = ["".join(rng.choice("ABCDé") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 100, 128, 130]))) for _ in range(90)]
    b = [edited(rng, x, rng.randint(0, 9), "ABz") if rng.random() < 0.7 else "".join(rng.choice("AB") for _ in range(rng.randint(0, 90))) for x in a]
    left, right, at = Pack(np.arange(90), pa.array(a)), Pack(np.arange(90), pa.array(b)), np.arange(90)
    want = [distance(x, y) for x, y in zip(a, b, strict=True)]
    assert distances(left, at, right, at).tolist() == want
    assert distances(right, at, left, at).tolist() == want
    monkeypatch.setattr(segjoin, "MANY_LETTERS", 64)
    assert distances(left, at, right, at).tolist() == want


RECORD = "rec_id long, split string, source_file string, protein_aa string, sequence string, id string, key string, held string, txt string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], RECORD)  # names that clash with inner ones


def test_split_overlap_is_exact(spark):
    rng = random.Random(8)
    proteins = family_texts(rng, "ACDEFGHIKLMNPQRSTVWY", 60, 5, 80, 0.12)
    sequences = family_texts(rng, "ACGT", 60, 10, 200, 0.12)
    rows = []
    for i in range(160):
        p = rng.choice([*proteins, None, "", " * "])
        s = rng.choice([*sequences, None, ""])
        if p and rng.random() < 0.3:
            p = f" {p.lower()[:4]}\n{p[4:]}*"
        if s and rng.random() < 0.3:
            s = s.replace("T", "u")
        rows.append((i if rng.random() > 0.02 else None, rng.choice(["train", "train", "val", "test", None, "odd"]), rng.choice("fg"), p, s))
    plain = lambda t, rna: None if t is None else ("".join(t.split()).replace("*", "").upper().replace("U", "T" if rna else "U") or None)
    forms = [(r[0], r[1], plain(r[3], False), plain(r[4], True)) for r in rows if r[0] is not None]
    want = set()
    for a in forms:
        for b in forms:
            if a[1] == "train" and b[1] in ("val", "test") and any(a[k] and b[k] and near(a[k], b[k], 1, 10) for k in (2, 3)):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    links, members = split_overlap(records(spark, rows))
    got = [tuple(r) for r in overlap_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap_report(records(spark, rows), links, members).collect()
    assert sum(r["n_records"] for r in report) == 160
    touched = {x for pair in want for x in pair}
    assert sum(r["n_overlap"] for r in report) == len(touched)


def test_split_overlap_empty(spark):
    links, members = split_overlap(records(spark, []))
    assert overlap_pairs(links, members).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("ACGT") for _ in range(6000))
    rows = [(1, "train", "f", None, long), (2, "val", "f", None, edited(rng, long, 200, "ACGT")), (3, "test", "f", None, long[:3000])]
    links, members = split_overlap(records(spark, rows))
    assert {tuple(r) for r in overlap_pairs(links, members).collect()} == {(1, 2)}


def test_clusters_are_components(spark, monkeypatch):
    rng = random.Random(12)
    texts = family_texts(rng, "ACDEFGHIKLMNPQRSTVWY", 90, 8, 50, 0.25)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0].lower()), (901, texts[0] + "*"), (902, None), (903, " "), (None, texts[1])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "group_no long, protein_aa string, uid string, cluster int")
    forms = [(i, "".join(t.split()).replace("*", "").upper()) for i, t in rows if i is not None and t and t.strip()]
    parent = {i: i for i, _ in forms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in forms:
        for j, b in forms:
            if i < j and near(a, b, 1, 4):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {(i, j) for i, _ in forms for j, _ in forms if i < j and find(i) == find(j)}
    members, classes = similarity_clusters(df)
    assert {tuple(r) for r in cluster_pairs(members).collect()} == want
    monkeypatch.setattr(density_clusters, "PAIRED", 2)
    split = [tuple(r) for r in cluster_pairs(members).collect()]
    assert set(split) == want and len(split) == len(want)
    links = cluster_links(members)
    assert links.count() == len(forms) and links.filter("names_cluster").count() == links.select("cluster").distinct().count()
    cl = classes.collect()
    by = {r["uid"]: r for r in cl}
    for r in cl:  # pointers lead to denser texts of the same cluster
        p = by[r["parent"]]
        assert p["cluster"] == r["cluster"] and (r["uid"] == r["parent"] or (p["density"], -p["uid"]) > (r["density"], -r["uid"]))
    assert sum(r["size"] for r in describe_clusters(classes).collect()) == len(forms)


def test_clusters_empty(spark):
    members, classes = similarity_clusters(spark.createDataFrame([], "group_no long, protein_aa string"))
    assert members.count() == classes.count() == 0


def cell(home, other, num, den, q, same=False):
    """The pairs of one cell that pass the q-gram bound, and how many pairs were tested for it."""
    tested = []
    rows = [(0, 0, 0, i, t) for i, t in enumerate(home)] + [(0, 1, 0, i if same else i + len(home), t) for i, t in enumerate(other)]
    schema = pa.schema([("cell", pa.int32()), ("side", pa.int32()), ("kind", pa.int32()), ("uid", pa.int64()), ("txt", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    bounded = segjoin.Segments._bounded
    with pytest.MonkeyPatch.context() as m:
        m.setattr(segjoin.Segments, "_bounded", lambda self, code, *rest: (tested.append(len(code)), bounded(self, code, *rest))[1])
        out = [(r["uid_a"], r["uid_b"]) for b in segjoin._cell_join(num, den, q, 4096, same, False, 4_000_000, 16_384)(iter([batch])) for r in b.to_pylist()]
    assert len(out) == len(set(out))
    return set(out), sum(tested)


def test_p2_random_sequences_rarely_meet():
    rng = random.Random(31)
    home, other = (["".join(rng.choices("ACGT", k=rng.randint(460, 500))) for _ in range(n)] for n in (500, 1000))
    other[::100] = [edited(rng, home[i], 44, "ACGT") for i in range(10)]
    found, tested = cell(home, other, 1, 10, 6)
    assert {(i, 500 + 100 * i) for i in range(10)} <= found
    assert tested < 150  # of 500 000 pairs


def test_p3_random_proteins_rarely_meet():
    rng = random.Random(32)
    texts = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(160, 190))) for _ in range(700)]
    texts[:10] = [edited(rng, t, 39, "ACDEFGHIKLMNPQRSTVWY") for t in texts[-10:]]
    found, tested = cell(texts, texts, 1, 4, 3, same=True)
    assert {(i, 690 + i) for i in range(10)} <= {(min(x), max(x)) for x in found}
    assert tested < 500  # of 244 650 pairs


@pytest.mark.parametrize("num,den,letters,low,high,q", [(1, 10, "ACGT", 1, 140, 6), (1, 10, "AB", 20, 90, 6), (1, 4, "ABCD", 1, 50, 3), (1, 2, "ABCD", 1, 20, 2), (3, 5, "AB", 1, 12, 2), (1, 40, "AC", 100, 300, 6)])
def test_cells_lose_no_pair(num, den, letters, low, high, q):
    rng = random.Random(high + den)
    texts = family_texts(rng, letters, 70, low, high, num / den)
    home, other = texts[::2], texts[1::2]

    def close(a, b):
        return abs(len(a) - len(b)) <= max(len(a), len(b)) * num // den and near(a, b, num, den)

    found, _ = cell(home, other, num, den, q)
    assert {(i, len(home) + j) for i, a in enumerate(home) for j, b in enumerate(other) if close(a, b)} <= found
    if 2 * num < den:
        found, _ = cell(texts, texts, num, den, q, same=True)
        assert {frozenset((i, j)) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if close(a, b)} <= {frozenset(x) for x in found}
