"""Nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import op01_secrets, op02_parity, op03_neighbours, op04_mixing, op05_decontaminate, op06_language, op07_pii, op08_licenses, op09_toxicity, op10_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "mail me at a.b@c.example and all rights reserved token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
ROWS = [
    (1, "you idiot! this is a plain text with some words in it and all rights reserved.", "en", "s0", 10),
    (1, "you idiot! this is a plain text with some words in it and all rights reserved.", "en", "s0", 10),
    (2, None, None, None, None),
    (3, "", "en", "s0", 0),
    (4, " \n\t ", "en", None, 3),
    (5, LONG, "en", "s1", len(LONG)),
    (None, "no id here, but cc by and 10.0.0.1", "en", "s1", 30),
    (6, "éè ça ñ 漢字 😀 +1 (017) 555-7713", "fr", "s2", 5),
]
CLASH = {"score": 1.0, "predicted": 2, "n_words": 3, "topic": "x", "weight": 4.0, "_id": 5, "h": 6, "spans": 7, "lang_pred": "q", "key": 8, "contaminated": True, "n_bytes": 9, "_found": 1}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (3, 1, 0), (5, 1, 0), (6, 0, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def clashing(docs):
    return docs.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def operators(spark, labels):
    bench = spark.createDataFrame([(1, "word word word word word word word word word word word"), (2, None), (3, ""), (None, "plain text"), (4, "this is a")], "item_id long, text string")
    none = bench.where("false")
    grammar = lambda d: op09_toxicity.fit(d, labels)
    forest = op01_secrets.fit(spark)
    return {
        "secrets": lambda d: op01_secrets.secret_findings(d, forest),
        "jaccard": lambda d: op02_parity.jaccard_classes(d, 4, 85, 100),
        "mixing": lambda d: op04_mixing.mix_sources(d, budget=1.0)[0],
        "contamination": lambda d: op05_decontaminate.contamination(d, bench)[0],
        "no_items": lambda d: op05_decontaminate.contamination(d, none)[0],
        "language": lambda d: op06_language.predict(d, op06_language.train(d))[0],
        "pii": op07_pii.pii_digest,
        "sanitise": op07_pii.sanitise,
        "licenses": op08_licenses.license_labels,
        "toxicity": lambda d: op09_toxicity.score(d, grammar(d)),
        "quality": lambda d: op10_quality.score(d, op10_quality.fit(d, labels)),
    }


NAMES = ["secrets", "jaccard", "mixing", "contamination", "no_items", "language", "pii", "sanitise", "licenses", "toxicity", "quality"]
FEWER = {"secrets"}  # a row per finding


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, docs, labels, name):
    run = operators(spark, labels)[name]
    out = run(docs).collect()
    assert len(out) == (1 if name in FEWER else len(ROWS))
    assert run(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, docs, labels, name):
    run = operators(spark, labels)[name]
    plain, more = run(docs), run(clashing(docs))
    if name in ("mixing", "contamination", "no_items", "language", "toxicity", "quality", "sanitise"):
        kept = [c for c in more.columns if c in CLASH]
        assert set(CLASH) <= set(more.columns), kept
        assert all(r[k] == v for r in more.select(*CLASH).collect() for k, v in CLASH.items())
    assert more.count() == plain.count()


def test_results_of_odd_rows(spark, docs, labels):
    runs = operators(spark, labels)
    j = {r.doc_id: r for r in runs["jaccard"](docs).collect()}
    assert j[2].n_shingles == 0 and j[2].component_id == 2 and j[3].component_id == 3 and j[None].component_id is None and j[1].component_id == 1
    # sixty thousand times one word: the runs of four, and those that reach into the end
    assert j[5].n_shingles == len({tuple(LONG.lower().split()[i : i + 4]) for i in range(len(LONG.split()) - 3)})
    lang = {r.doc_id: r for r in runs["language"](docs).collect()}
    assert lang[2].lang_pred == "und" and lang[4].lang_pred == "und" and lang[6].lang_pred == "fr" and 0 <= lang[6].score <= 1
    p = {r.doc_id: r for r in runs["pii"](docs).collect()}
    assert (p[5].n_email, p[None].n_ip, p[6].n_phone, p[2].n_email) == (1, 1, 1, 0) and p[6].spans == "phone:13:30"
    clean = {r.doc_id: r.text for r in runs["sanitise"](docs).collect()}
    assert clean[6].endswith("[PHONE]") and clean[2] is None and clean[3] == "" and "[EMAIL]" in clean[5] and clean[1] == ROWS[0][1]
    lic = {r.doc_id: r for r in runs["licenses"](docs).collect()}
    assert lic[1].base_labels == "reserved" and lic[None].base_labels == "cc-by" and lic[2].n_words == 0 and lic[2].first_word is None and lic[5].n_base == 1 and lic[3].labels == ""
    c = {r.doc_id: r for r in runs["contamination"](docs).collect()}
    assert c[5].contaminated and c[5].n_hit == 60_000 and not c[2].contaminated and c[1].n_items == 1 and c[1].n_hit == 3 and c[2].n_words == 0
    s = runs["secrets"](docs).collect()
    assert [(r.doc_id, r.value) for r in s] == [(5, "04dbebab91ab85687d33eeaaf9ac699e1188f962")]


def test_no_labels_give_a_half(spark, docs, labels):
    none = labels.where("false")
    t = op09_toxicity.score(docs, op09_toxicity.fit(docs, none)).collect()
    q = op10_quality.score(docs, op10_quality.fit(docs, none)).collect()
    assert {r.score for r in t} == {0.5} and {r.score for r in q} == {0.5} and {r.predicted for r in t} == {1}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(0, [0.0, 1.0, 0.0]), (100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0]), (106, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "class": F.lit(2), "q": F.lit(3)})
    query = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    out = op03_neighbours.nearest(df, query).collect()
    assert len(out) == 10 and {r.query_id for r in out} == {0, 20} and all(r.vec_id < 40 and r.vec_id != r.query_id for r in out)
    assert op03_neighbours.nearest(df.where("false"), query).count() == 0
    # fewer candidates than asked for
    assert op03_neighbours.nearest(df.where("vec_id in (0, 1, 2)"), query).count() == 2
