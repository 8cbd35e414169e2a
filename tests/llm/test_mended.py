"""Cases that went wrong before: deep pages, spans beside base spans, text item ids, long texts of many lines, repeated ids."""

import random
import time

import numpy as np

from ligandloom.llm import decontaminate, html_text, line_crf, secret_scan, toxicity


def test_deep_pages_take_linear_time(spark):
    n = 100_000
    page = "<html><body><article>" + "<div>" * n + "<p>One, two, three words here.</p>" + "</div>" * n + "</article></body></html>"
    at = time.monotonic()
    html_text.Page(page)
    assert time.monotonic() - at < 5
    docs = spark.createDataFrame([(1, "u", page[: 40_000] + "<p>Text, that is kept, of a page.</p>")], "page_id long, url string, html string")
    assert html_text.extract_pages(docs).count() == 1


def test_random_parts_beside_base_spans_are_found():
    rng = random.Random(6)
    scan = secret_scan.Scanner(secret_scan.read_ranks())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    alone = lost = 0
    for _ in range(600):
        digest = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
        tail = "".join(rng.choice(letters) for _ in range(rng.randrange(20, 25)))
        if [k for _, k, _ in scan.spans(tail.encode())] == [3]:
            alone += 1
            for joint in "/=":
                found = scan.spans(f"{digest}{joint}{tail}".encode())
                lost += not any(k == 3 and e == len(digest) + 1 + len(tail) for _, k, e in found)
    assert alone > 500 and lost == 0


def test_item_ids_may_be_texts(spark):
    body = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([("a", f"x {body} y"), ("b", "nothing here"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([("item one", body), (None, None)], "name string, text string")
    got = decontaminate.leaks(docs, items, item_key="name").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [("a", "item one")]
    left = decontaminate.without_leaks(docs, items, item_key="name")
    assert sorted(map(str, left.select("doc_id").collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 'b'").select("doc_id").collect()))


def test_texts_of_many_lines_teach(spark):
    """400 lines each, the classes plainly different; ids that repeat do not make the model depend on the partitions."""
    rng = random.Random(7)
    good = ["The committee met on Monday and agreed on a plan.", "A long report, with care, was written and read."]
    bad = ["CLICK $$$ >>> 100% FREE ### |||", "*** BUY NOW *** <<<>>> $$$ %%%"]
    rows = [(k, "\n".join(rng.choice(good if k % 2 else bad) for _ in range(400)), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(0, "another text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    first = {(r.doc_id, round(r.score, 4)) for r in line_crf.score_documents(docs.repartition(3), labels).collect()}
    again = {(r.doc_id, round(r.score, 4)) for r in line_crf.score_documents(docs.repartition(5, "text"), labels).collect()}
    assert first == again
    right = sum((score >= 0.5) == bool(k % 2) for k, score in first if k > 0)
    assert right >= 57


def test_lexicon_grows_by_significance(spark):
    """Every word that marks toxic texts is learned, however many there are and however short; common words are not."""
    rows = [(f"{k} the zog{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}x uff ran {k}".encode(), 1) for k in range(2000)]
    rows += [(f"{k} the dog ran away {k}".encode(), 0) for k in range(6000)]
    train = spark.createDataFrame(rows, "body binary, toxic int")
    terms = toxicity.learn_terms(train)
    want = {f"zog{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst"} | {"uff"}
    assert set(terms) == want | set(toxicity.SEED)
    near = [(f"only one text says blorb and more that is always the same in each of them {k}".encode(), 1) for k in range(500)]
    copies = spark.createDataFrame(near + rows, "body binary, toxic int")
    assert "blorb" not in toxicity.learn_terms(copies)
    assert toxicity.learn_terms(train.limit(0)) == toxicity.SEED


def test_chance_finds_in_long_texts_weigh_less():
    model = toxicity.Model(["idiot"], np.array([1.0]), np.array([0.6]), -4.0, 0.5, 6.0)
    short, long = (toxicity.evidence(model, [(0, 1, 1.0)] * 3, n) for n in (200, 20_000))
    assert short[0] == long[0] and short[1] > long[1]
    assert toxicity.evidence(model, [], 0) == toxicity.evidence(model, [], 10**6) == (0.0, 0.0)
    x = np.array([[0.1, 0.1], [1.0, 1.0], [2.0, 0.2], [0.2, 0.1]])
    bias, *weights = toxicity.fit_curve(x, np.array([0.0, 1.0, 0.0, 0.0]), np.full(4, 50.0))
    assert bias < 0 and min(weights) >= 0 and weights[1] > 1
    assert toxicity.fit_curve(np.zeros((2, 2)), np.array([0.0, 1.0]), np.array([9.0, 1.0]))[1:] == (0.0, 0.0)


def test_curve_over_one_column():
    """The line field has one column of evidence, the lexicon two."""
    x, n = np.array([0.1, 0.2, 0.9, 0.8]), np.full(4, 20.0)
    bias, slope = toxicity.fit_curve(x, np.array([0.0, 0.0, 1.0, 1.0]), n)
    assert bias + slope * 0.1 < 0 < bias + slope * 0.9
    bias, slope = toxicity.fit_curve(x, np.array([1.0, 1.0, 1.0, 0.0]), n)
    assert slope == 0.0 and bias > 0
