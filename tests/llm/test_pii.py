from collections import Counter

from trussflow.llm import pii
from trussflow.llm.pii_table import labelled_rows


def test_frames_held_out_whole_are_tagged():
    """Frames that are not in the training table at all, filled with values made up anew."""
    tagger = pii.Tagger(*pii.train(part="train"))
    rows = labelled_rows(600, seed=4321, part="test")
    hit, wrong, missed = Counter(), Counter(), Counter()
    for (_, gold), found in zip(rows, tagger.spans([t for t, _ in rows])):
        g, f = {(a, k) for a, _, k in gold}, {(a, k) for a, _, k in found}
        hit.update(k for _, k in g & f)
        wrong.update(k for _, k in f - g)
        missed.update(k for _, k in g - f)
    recall = {k: hit[k] / (hit[k] + missed[k]) for k in pii.KINDS}
    assert recall["phone"] > 0.9 and recall["address"] > 0.9 and recall["email"] > 0.8 and recall["name"] > 0.8 and recall["id_number"] > 0.6
    assert hit.total() / (hit.total() + wrong.total()) > 0.9


def test_viterbi_matches_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    em = r.normal(size=(5, pii.LABELS)).astype("f4")
    trans = (r.normal(size=(pii.LABELS, pii.LABELS)) + pii._allowed()).astype("f4")
    got = pii.viterbi(em, trans, [(0, 4), (4, 5)])
    best = max(itertools.product(range(pii.LABELS), repeat=4), key=lambda y: trans[0, y[0]] + em[0, y[0]] + sum(trans[y[k - 1], y[k]] + em[k, y[k]] for k in range(1, 4)))
    assert tuple(got[:4]) == best


def test_find_and_redact(spark):
    texts = ["Contact for the valves: Ms Anna Vandermeer, anna.vandermeer (at) corvale.test, +44 20 7946 0123. Keys are with Paul Hill, Flat 4, 11 Tannery Road, Corvale QX1 2ZZ.", None, "", "Serial 097-575680 was read twice. Will mark the wall and beam again this week.", "Gate pass: J. Holt, SSN 920-11-2233, valid on Tuesday.\n" * 3]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kind string")
    found = sorted((r.doc_id, r.start_pos, r.kind, r.found) for r in pii.find(df).collect())
    assert [(f[2], f[3]) for f in found if f[0] == 0] == [("name", "Anna Vandermeer"), ("email", "anna.vandermeer (at) corvale.test"), ("phone", "+44 20 7946 0123"), ("name", "Paul Hill"), ("address", "Flat 4, 11 Tannery Road, Corvale QX1 2ZZ")]
    assert all(texts[f[0]][f[1] - 1 :].startswith(f[3]) for f in found)
    assert len([f for f in found if f[0] == 4]) == 6 and not [f for f in found if f[0] in (1, 2, 3)]
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] is None and out[2] == "" and out[3] == texts[3] and out[0].startswith("Contact for the valves: Ms <NAME>, <EMAIL>, <PHONE>. Keys are with <NAME>, <ADDRESS>")
    assert pii.find(df.where("false")).count() == 0


def test_very_long_text_is_processed_whole(spark):
    text = "Weather dry, 12 people fixed valves in zone K. " * 20_000 + "Checked by Anna Vandermeer after the handover."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.kind, r.found) for r in pii.find(df).collect()] == [("name", "Anna Vandermeer")]


def test_spans_of_long_texts_are_not_cut():
    tagger = pii.Tagger(*pii.train())
    line = "Call +44 20 7946 0123 or write to anna.vandermeer@corvale.test.\n"
    for shift in range(0, 24, 3):
        text = "x " * shift + line * 400
        want = [text.index(line) + k * len(line) + line.index(s) for k in range(400) for s in ("+44", "anna.")]
        assert [a for a, _, _ in tagger.spans([text])[0]] == want
        assert {text[a:b] for a, b, _ in tagger.spans([text])[0]} == {"+44 20 7946 0123", "anna.vandermeer@corvale.test"}


def test_edges_of_names_and_emails():
    """Words that open a sentence, letters of grid lines, compounds with a letter and streets are no names; plain emails are whole."""
    tagger = pii.Tagger(*pii.train())
    plain = [
        "If a skylight frame has no drip edge, order one.", "Der K-Wert für Kellerdecke fehlt, der U-Wert auch.", "Some lintels next to grid G. It leaks there again.",
        "Bitte den U-Wert der Fassade nachtragen.", "Jeudi, le relevé du parking sera repris.", "A pre-cut batch of the trim came late.", "upload@7 worker-31 failed after 12 s",
    ]
    assert [t for t, s in zip(plain, tagger.spans(plain)) if s] == []
    texts = {
        "Copy ruth.okafor+plans@harbourgroup.example; omar.said+west@harbourgroup.example please": [("email", "ruth.okafor+plans@harbourgroup.example"), ("email", "omar.said+west@harbourgroup.example")],
        "Die Rampe ist fertig.\nGruß, Sabine": [("name", "Sabine")],
        "Ring the bell and wait for Mrs. Okafor. Windows stay shut.": [("name", "Okafor")],
        "steuerliche Identifikationsnummer: 47036892816": [("id_number", "47036892816")],
    }
    assert {t: [(k, t[a:b]) for a, b, k in s] for t, s in zip(texts, tagger.spans(list(texts)))} == texts


def test_form_checks_of_spans():
    def kept(text, span, kind):
        a = text.index(span)
        ok = pii._checked(text, a, a + len(span), kind)
        return ok and text[slice(*ok)]

    assert kept("Thanks.\nGruß, Anna Hill", "Gruß, Anna Hill", "name") == "Anna Hill" and kept("paid by Anna Hill If so", "Anna Hill If", "name") == "Anna Hill"
    assert kept("near grid G. Found it", "G. Found", "name") is None and kept("asked G. Holt", "G. Holt", "name") == "G. Holt" and kept("+ IfcWall]", "+ IfcWall", "name") is None
    assert kept("12. 0161 496 0543 rings", "12. 0161 496 0543", "phone") == "0161 496 0543" and kept("build@38 ran", "build@38", "email") is None
    assert kept("Raum 12, Breite 3,2 m.", "Raum 12, Breite 3,2", "address") is None and kept("Am Tor 3, 12345 Lindau", "Am Tor 3, 12345 Lindau", "address") == "Am Tor 3, 12345 Lindau"
