"""Spans in written-out texts, lookalikes that are none, and redaction."""

import random

import pytest

from loomspan.llm import personal as P

NAMES = [("Anna", "given"), ("Jean-Luc", "given"), ("Søren", "given"), ("Mei", "given")] + [(s + "mund", "family") for s in ("Tora", "Hala", "Åka", "Kela")] + [(s + "ovska", "family") for s in ("Bran", "Gor", "Vel", "Yar")] + [("O'Kell", "family")]
TEXTS = [
    ("Please write to anna.x+1@lab.example.org before Friday.", {("email", "anna.x+1@lab.example.org")}),
    ("mail=ANNA@LAB.EXAMPLE", {("email", "ANNA@LAB.EXAMPLE")}),
    ("Contact: anna.x [at] lab [dot] example [dot] org", {("email", "anna.x [at] lab [dot] example [dot] org")}),
    ("Questions go to <anna at lab dot example> before noon.", {("email", "anna at lab dot example")}),
    ("mailto:anna(at)lab.example", {("email", "anna(at)lab.example")}),
    ("Call +44 20 7946 0768 when it is locked.", {("phone", "+44 20 7946 0768")}),
    ("Phone (01632) 960918, ext. 23, mornings only.", {("phone", "(01632) 960918")}),
    ("Ring 713.555.0189 about it.", {("phone", "713.555.0189")}),
    ("Tel.: 030/23125-997", {("phone", "030/23125-997")}),
    ("Passport no. C06Z91115 (field permit).", {("id_number", "C06Z91115")}),
    ("Social security number 951-38-5511 was left there.", {("id_number", "951-38-5511")}),
    ("National insurance: QQ 12 34 56 C.", {("id_number", "QQ 12 34 56 C")}),
    ("She lives at 153-A Quarry Mill Court and collects seed.", {("address", "153-A Quarry Mill Court")}),
    ("Adresse: 12, avenue du Lavoir", {("address", "12, avenue du Lavoir")}),
    ("Dirección / Anschrift: Erlenstraße 12b", {("address", "Erlenstraße 12b")}),
    ("Home address: Calle Mayor Vieja, 40", {("address", "Calle Mayor Vieja, 40")}),
    ("Thanks to Anna M. Toramund for the patch.", {("person", "Anna M. Toramund")}),
    ("operator: Halamund, Jean-Luc", {("person", "Halamund, Jean-Luc")}),
    ("Collected by ANNA VELOVSKA on 2024-01-02.", {("person", "ANNA VELOVSKA")}),
    ("Prof. Søren von der Åkamund, karyotype group", {("person", "Søren von der Åkamund")}),
    ("We asked K. Goroloska whether", set()),
    ("We asked Pavel Kelamund whether it was masked.", {("person", "Pavel Kelamund")}),
    ("The Toramund index of QV-001 is 3.", set()),
    ("cultivar 'Anna' was grown at Mill Road.", set()),
    ("Primer lot 39-798-272340 amplified 376 bp.", set()),
    ("run exonloom@4.19.2 and N50@scaffold", set()),
    ("Plot 57 at Mill Road was sampled on 06.03.2022; 62 seedlings", set()),
    ("accession LZX873665 clusters", set()),
    ("[2022-09-18 06:17:41] start=40205074 end=49,094,111", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows, at = [], 0
    for i in range(40):  # enough votes to learn from
        for t, _ in TEXTS:
            rows.append((at, t if i else f"{t}\n{t}"))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    names = spark.createDataFrame([*NAMES, NAMES[0], (None, "given"), ("x", None)], "name string, kind string")
    return docs, names, [tuple(r) for r in P.personal_spans(docs, names).collect()]


def test_written_cases(found):
    _, _, rows = found
    assert len(rows) == len(set(rows))
    by = {}
    for d, k, v in rows:
        by.setdefault(d, set()).add((k, v))
    for i, (text, want) in enumerate(TEXTS):
        assert by.get(i, set()) == want, text
        assert by.get(len(TEXTS) + i, set()) == want, text


def test_redaction(spark, found):
    docs, names, rows = found
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r["text"] for r in P.redact(docs, names).collect()}
    assert set(out) == set(texts)
    for d, t in texts.items():
        spans = [(k, v) for x, k, v in rows if x == d]
        if t is None:
            assert out[d] is None
            continue
        want = t
        for k, v in spans:
            want = want.replace(v, f"[{k.upper()}]")
        assert out[d] == want


def test_empty_tables(spark, found):
    docs, names, _ = found
    assert P.personal_spans(docs.limit(0), names).count() == 0
    kinds = {r["kind"] for r in P.personal_spans(docs, names.limit(0)).select("kind").distinct().collect()}
    assert "person" not in kinds and "email" in kinds
    assert P.redact(docs.limit(0), names).count() == 0


def test_long_texts_are_searched_whole():
    names = P.Names.of(NAMES)
    text = "A" * 300_000 + " " + "x@" * 2000 + " 1" * 20_000 + " tail: Thanks to Anna Toramund, call +44 20 7946 0768."
    got = {(P.KINDS[k], text[s:e]) for k, s, e, *_ in P.candidates(text, names)}
    assert ("person", "Anna Toramund") in got and ("phone", "+44 20 7946 0768") in got


def test_candidates_survive_noise():
    rng, names = random.Random(3), P.Names.of(NAMES)
    alphabet = list("aA1 .,@+()-\n/'\"") + ["Toramund", "Anna", " at ", " dot ", "straße", "é", "𝛼"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        for _, s, e, *_ in P.candidates(t, names):
            assert 0 <= s < e <= len(t)


def test_em_recovers_reliabilities():
    rng, counts = random.Random(1), {}
    good = [0.95, 0.9, 0.7]
    for _ in range(20_000):
        y = rng.random() < 0.4
        v = "".join("0" if rng.random() < 0.2 else "+" if (rng.random() < g) == y else "-" for g in good)
        counts[v] = counts.get(v, 0) + 1
    r, p = P.estimate(counts)
    assert all(abs(a - b) < 0.04 for a, b in zip(r, good))
    assert p["+++"] > 0.95 and p["---"] < 0.05
