import random

from trussflow.llm import contamination as c

ITEM = "Between the second survey and the schema upgrade, the fire consultant exports 38 cable trays in core 315 as a list. Which warranty date belongs to the parapet coping below the gallery once 139 column bases of 364 millimetres are taken away until the next export?"


def _docs(spark, *texts):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")


def _items(spark, *texts):
    return spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "item_id long, text string")


def _pairs(spark, texts, items=(ITEM,)):
    return sorted((r.doc_id, r.item_id) for r in c.leaks(_docs(spark, *texts), _items(spark, *items)).select("doc_id", "item_id").distinct().collect())


def test_disguises_do_not_hide_a_leak(spark):
    w = ITEM.split()
    lines = [" ".join(w[i : i + 6]) for i in range(0, len(w), 6)]
    texts = [
        "x " + ITEM + " y", ITEM.upper(), "\n".join("> " + x for x in lines), "\n".join(f"[07:1{k % 10}] {x}" for k, x in enumerate(lines)), "\n".join(f"{k + 1}. {x}" for k, x in enumerate(lines)),
        "\n".join("| " + x for x in lines), " ".join(f"**{x}**" if k % 3 == 0 else x for k, x in enumerate(w)), "<p>" + "&nbsp;".join(w) + "</p>", ITEM.replace("gallery", "gal-\nlery").replace("fire", "ﬁre"), ITEM.replace(" ", " "), ITEM.replace("parapet", "para­pet"),
    ]
    assert _pairs(spark, texts) == [(k, 100) for k in range(len(texts))]


def test_a_wrapped_line_may_begin_with_a_number(spark):
    item = "freezes every balcony slab thicker than 4.380 m and leaves 70 reinforcement cages around the atrium open"
    assert _pairs(spark, ["freezes every\tbalcony slab thicker than \n  4.380 m and leaves \n  70 reinforcement cages\naround the atrium open"], [item]) == [(0, 100)]


def test_lengths_and_edits(spark):
    w = c.words(ITEM)
    run = lambda n: "aa bb " + " ".join(w[4 : 4 + n]) + " cc dd"
    edited = list(w[:24])
    for k in (6, 13, 20):
        edited[k] = "zz"
    four = list(w[:24])
    for k in (5, 10, 15, 20):
        four[k] = "zz"
    added = w[:10] + ["zz"] + w[10:19] + w[20:26]
    texts = [run(13), run(12), "q " + " ".join(edited) + " q", "q " + " ".join(four) + " q", "q " + " ".join(added) + " q", None, "", "short"]
    assert _pairs(spark, texts) == [(0, 100), (2, 100), (4, 100)]


def test_matches_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(30)]
    items = [" ".join(r.choice(vocab) for _ in range(r.randint(5, 60))) for _ in range(8)]
    docs = []
    for _ in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 2)):
            it = r.choice(items).split()
            a = r.randint(0, len(it) - 1)
            piece = [x if r.random() > 0.1 else "zz" for x in it[a : a + r.randint(5, 40)]]
            w += piece + [r.choice(vocab) for _ in range(5)]
        docs.append(" ".join(w))

    def brute(d, i):
        # least edits of item[a:b] against any piece of the document, for every start a
        for a in range(len(i)):
            row = [0] * (len(d) + 1)
            runs = [0] * (len(d) + 1)
            for b in range(a, len(i)):
                new, nruns = [row[0] + 1], [0]
                for k in range(1, len(d) + 1):
                    same = d[k - 1] == i[b]
                    new.append(min(row[k - 1] + (not same), row[k] + 1, new[-1] + 1))
                    nruns.append(runs[k - 1] + 1 if same else 0)
                row, runs, n = new, nruns, b - a + 1
                if max(runs) >= 13 or n >= 24 and 8 * min(row) <= n:
                    return True
        return False

    want = sorted((k, 100 + j) for k, d in enumerate(docs) for j, i in enumerate(items) if brute(c.words(d), c.words(i)))
    assert want and _pairs(spark, docs, items) == want


def test_reparameterised(spark):
    other = ITEM.replace("38", "77").replace("315", "9").replace("139", "1").replace("364", "5")
    mixed = ITEM.replace("38", "77", 1)
    got = {(r.doc_id, r.item_id): r.changed for r in c.reparameterised(_docs(spark, other, ITEM, mixed), _items(spark, ITEM)).collect()}
    assert got == {(0, 100): 4, (2, 100): 1}


def _changed(spark, item, *texts):
    return {r.doc_id: (r.template_run, r.changed) for r in c.reparameterised(_docs(spark, *texts), _items(spark, item)).collect()}


def test_exchanged_names(spark):
    item = "After the handover Anna Vandermeer of Corvale Works asks Paul Hill whether the doors of Tannery House were counted by Anna Vandermeer again."
    new = {"Anna": "Ruth", "Vandermeer": "Okafor", "Corvale": "Delmont", "Paul": "Igor", "Hill": "Brandt", "Tannery": "Harbour"}
    other = item
    for a, b in new.items():
        other = other.replace(a, b)
    once = item.replace("Paul", "Igor")
    assert _changed(spark, item, other, item, once, other.replace("asks", "tells")) == {0: (23, 8), 2: (23, 1), 3: (14, 5)}


def test_a_run_goes_on_after_an_inconsistent_slot(spark):
    item = "the survey of 12 columns in core 7 was sent to the lead engineer before 12 beams were moved to the yard of the plant for the next five weeks"
    w = c.words(item)
    mixed = " ".join({3: "40", 15: "50"}.get(k, x) for k, x in enumerate(w))
    assert w[3] == w[15] == "12" and _changed(spark, item, mixed) == {0: (len(w) - 4, 1)}
    assert dict(enumerate(c._exchanges([("a", "1"), ("b", "b"), ("c", "1"), ("b", "b")]))) == {0: (2, 1), 1: (3, 1)}


def test_empty_tables(spark):
    assert c.leaks(_docs(spark, "a").where("false"), _items(spark, ITEM)).count() == 0
    assert c.leaks(_docs(spark, ITEM), _items(spark, ITEM).where("false")).count() == 0
