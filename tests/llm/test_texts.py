"""Leaks, residue and mixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codonloom.llm import eval_leaks
from codonloom.llm.eval_leaks import Finder, find_leaks, item_words, words
from codonloom.llm.mixture import budgets, fit_counts, mix
from codonloom.llm.residue import Scanner, _phrases, drop_residue, scan_residue
from codonloom.llm.tokens import count_tokens, default_path

from notices import NOTICES, SPOKEN_OF

ITEM = "Read the passage.\nThe antiporter Lenket-18 exchanges 64 protons for each molecule of vamurqua carried outward, and its stoichiometry was settled at Taldumisund. Deleting the leader of Tertro-11 exposes a hairpin whose 88 base pairs sequester the start site."
OTHER = "Read the passage.\nCrystals obtained from Scaket diffract to 1.43 angstroms and reveal a lonexbel dimer held together by 26 buried salt bridges, whereas heating destroys the foldase but spares the talphoban disaggregase."


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_words():
    assert words("<p>L'É&nbsp;té</p> ﬁn foot-\nnote 1.5") == ["l", "e", "te", "fin", "footnote", "15"]


def test_item_words(spark):
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, " "), (5, "Alone.\nA line of words"), (6, "Read the passage."), (1, "shorter")], "item_id long, item_text string")
    got = {r["item"]: r["own"] for r in item_words(items).collect()}
    assert set(got) == {1, 2, 5, 6} and got[1][0] == "the" and got[5][0] == "alone" and got[6] == ["read", "the", "passage"]


def test_leaks_in_loads_and_blocks(spark, monkeypatch):
    vocab = ["gene", "codon", "protein", "signal", "stable", "kinase", "host", "assay", "yeast", "buffer"]
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + " " + items[i % 30][1]) for i in range(60)]
    i, d = spark.createDataFrame(items, "item_id long, item_text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(tuple(r) for r in find_leaks(d, i).collect())
    assert len(want) >= 60
    monkeypatch.setattr(eval_leaks, "SHIPPED", 200)
    monkeypatch.setattr(eval_leaks, "BLOCK", 4)
    assert sorted(tuple(r) for r in find_leaks(d, i).collect()) == want


def test_finder_is_exact():
    rng = random.Random(6)
    vocab = ["the", "of", "a", "in", "lab", "gene", "codon", "protein", "x1", "42", "signal", "stable"]
    items = {i: [rng.choice(vocab) for _ in range(rng.randint(4, 12))] for i in range(8)}
    finder = Finder(items, 0.55, 4)
    for _ in range(250):
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            own = items[rng.randrange(8)]
            doc[3:3] = [w for w in own if rng.random() < 0.7]
        want = {}
        for i, own in items.items():
            best = max((lcs(doc[s : s + 2 * len(own)], own) for s in range(len(doc))), default=0)
            if best >= 0.55 * len(own):
                want[i] = best / len(own)
        assert dict(finder.find(" ".join(doc))) == pytest.approx(want)


def test_leaks(spark):
    body = ITEM.split("\n")[1]
    ws = body.split()
    docs = [
        (1, "Note. " + body.upper() + " End."), (2, "<b>" + body.replace(" ", "\n") + "</b>"), (3, " ".join(ws[: int(len(ws) * 0.7)])), (4, " ".join(ws[:8])), (5, "Read the passage."), (6, None), (7, ""), (8, " ".join(reversed(ws))),
        (1, body), (None, body), (9, "filler word " * 40_000 + body),
    ]
    d = spark.createDataFrame([(*x, "i") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(10, ITEM, 1), (11, OTHER, 1), (12, None, 1), (13, "", 1), (10, "x", 1)], "item_id long, item_text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(d, i).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (9, 10)}
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


RESIDUE = [
    "We are sorry, the requested entry could not be found", "Erreur 404 : la page demandée est introuvable.", "Leider Seite nicht vorhanden - Bitte in 22 Minuten wiederkommen!", "Lo sentimos, la página fue retirada", "Please enable JavaScript to view this entry.",
    "Für die Anzeige, schalten Sie Skripte ein und laden neu.", "To use the browser for alignments, turn JavaScript on.", "Prepared by {{author}} on ${date}", "Host: <plddt_mean>", "Bei {strain} ändert die Prüfung nichts am Wert.", "[Methods will be added by the author]",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TBD TBD TBD", '{"error": {"code": 500, "message": "boom"}}', "KeyError: 'protein_id'", "<html><body><h1>Acceso denegado</h1></body></html>", "Su texto aquí", "Résumé à rédiger", "Gene: undefined", "A result was found.\nAccess denied.\nThe plate was kept.",
]
CLEAN = [
    "In the report template the field {{protein_id}} is replaced by the accession before anything is mailed.", "A KeyError in the integrator means that a record has no host; the row is skipped and counted.", "Set the path with `export DATA=${HOME}/runs` and start the converter again.",
    "The primer reads 5'-ATG[N]60TAA-3', where [N] is any codon except a stop.", 'When the alignment server returned "503 Service unavailable" for 12 queries, we repeated them the next morning.', "The old viewer told users to enable JavaScript; the new one is plain HTML and asks for nothing.",
    "Filler such as lorem ipsum has to be taken out of the methods section before review.", 'The guideline forbids notes like "to be completed" or "your text here" in released entries.', "Die alte Ansicht verlangte JavaScript, die neue kommt seit 9 Wochen ohne aus.", "If a page says that access was denied, ask the curator for an account.",
    "Dans le modèle, {{protein_id}} est remplacé par le numéro avant l'envoi.", 'The string format is f"{host}_{index:05d}", for instance E_coli_00042.', "The protein could not be found in the second run of the screen with mouse cells.", "nexdra\t71.26\t0.473",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert Scanner().scan(text)[0]


@pytest.mark.parametrize("text", CLEAN)
def test_no_residue(text):
    assert not Scanner().scan(text)[0]


@pytest.mark.parametrize("lang", sorted(NOTICES))
def test_held_out_notices(lang):
    """Recall on notices that the phrase lists were not made from."""
    scanner, lines = Scanner(), NOTICES[lang].splitlines()
    assert sum(scanner.scan(x)[0] for x in lines) >= 0.9 * len(lines)


def test_sentences_that_speak_of_notices():
    scanner = Scanner()
    assert not [x for x in SPOKEN_OF if scanner.scan(x)[0]]


def test_phrases_in_all_alternatives():
    assert _phrases("a {b|c} d|e\n{f|} g|") == ["a b d", "a c d", "e", "f g", "g"]


def test_residue_table(spark):
    rows = [(i, t, "x") for i, t in enumerate([*RESIDUE[:3], *CLEAN[:3], None, "", "  ", RESIDUE[0]])] + [(None, RESIDUE[1], "x"), (99, "word " * 50_000 + "\n" + RESIDUE[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_residue string")
    got = scan_residue(df).filter("is_residue").collect()
    assert sorted(str(r["id"]) for r in got) == sorted(["0", "1", "2", "9", "99", "None"])
    assert {r["doc_id"] for r in drop_residue(df).collect()} == {3, 4, 5, 6, 7, 8, None}
    assert scan_residue(df.limit(0)).count() == 0


def best_below(budget, counts):
    texts = [n for n, c in counts.items() for _ in range(c)]
    return max(s for k in range(len(texts) + 1) for c in itertools.combinations(texts, k) if (s := sum(c)) <= budget)


def test_fit_is_optimal():
    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(0, 200)
        got = fit_counts(budget, counts)
        assert all(0 < c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == best_below(budget, counts)


def test_fit_large():
    rng = random.Random(1)
    counts = {rng.randint(20, 4000): rng.randint(1, 900) for _ in range(800)}
    size = sum(n * c for n, c in counts.items())
    for share in (0.1, 0.5, 0.93):
        got = fit_counts(int(size * share), counts)
        assert sum(n * c for n, c in got.items()) == int(size * share) and all(c <= counts[n] for n, c in got.items())
    assert fit_counts(size + 5, counts) == counts and fit_counts(-1, counts) == {} and fit_counts(5, {}) == {}


def test_fit_keeps_the_lengths_of_the_source():
    rng = random.Random(6)
    lengths = sorted(max(1, int(rng.lognormvariate(5.5, 0.8))) for _ in range(10_000))
    counts, size = Counter(lengths), sum(lengths)
    bounds = [lengths[len(lengths) * i // 5] for i in range(5)] + [lengths[-1] + 1]
    for share in (0.02, 0.05, 0.07, 0.09, 0.3, 0.6):  # both sides of the most tokens of a fit
        got = fit_counts(int(size * share), counts)
        assert sum(n * c for n, c in got.items()) == int(size * share)
        texts = sum(got.values())
        assert abs(int(size * share) / texts / (size / len(lengths)) - 1) < 0.1
        for low, high in itertools.pairwise(bounds):
            want = sum(c for n, c in counts.items() if low <= n < high) / len(lengths)
            assert abs(sum(c for n, c in got.items() if low <= n < high) / texts - want) < 0.05


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", " A ", "b", "c", None]), rng.randint(0, 60)) for i in range(400)] + [(None, "a", 7), (3, "a", 7)]
    sizes = spark.createDataFrame([(i, s.strip().lower() if s else None, n) for i, s, n in rows], "doc_id long, key string, n_tokens long")
    targets = spark.createDataFrame([("A", 0.3, 3), ("b", 0.1, 1), ("c", 0.5, 1), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    plan = {r["source"]: r for r in budgets(sizes, targets).collect()}
    assert {s for s, r in plan.items() if not r["reachable"]} == {"c", "gone"}
    chosen, report = mix(sizes, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert all(rep[s]["tokens"] == rep[s]["budget"] for s in ("A", "b"))
    assert rep["c"]["tokens"] == rep["c"]["size"] and rep["gone"]["tokens"] == 0
    assert chosen.groupBy("source").agg(F.max("copies").alias("m")).filter("source = 'A'").first()["m"] <= 3
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-5
    again, _ = mix(sizes, targets)
    key = lambda r: (str(r["doc_id"]), r["source"], r["n_tokens"], r["copies"])
    assert sorted(map(key, chosen.collect())) == sorted(map(key, again.collect()))
    c0, r0 = mix(sizes.limit(0), targets)
    assert c0.count() == 0 and all(r["tokens"] == 0 for r in r0.collect())


def test_tokens(spark):
    import os

    if not os.path.exists(default_path()):
        pytest.skip("no vocabulary files")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> é")], "i long, text string")
    got = {r["i"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3
