"""Cases that a bound within the work would miss."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import op01_secrets, op04_mixing, op07_pii
from millrace.llm.store import Workspace


def test_terms_far_from_an_entity(spark):
    gap = " ".join(f"plain{j}" for j in range(20))
    rows = [(i, f"Zarko wrote {i} {gap} mail zq@x.example then {gap} {gap} and Zarko replied") for i in range(3)]
    rows += [(10 + i, f"someone wrote {gap} mail then {gap} {gap} and replied {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in op07_pii.pii_digest(df).collect()}
    clean = {r.doc_id: r.text for r in op07_pii.sanitise(df).collect()}
    for i in range(3):
        assert out[i].n_terms == 2 and out[i].spans.startswith("term:0:5,")
        assert "Zarko" not in clean[i] and clean[i].count("[TERM]") == 2 and "[EMAIL]" in clean[i]
    assert all(out[10 + i].spans == "" and clean[10 + i] == rows[3 + i][1] for i in range(60))


def test_assigned_secrets_of_any_length(spark):
    value = "".join("0123456789abcdef"[(i * i * 7 + i // 16 * 5 + i) % 16] for i in range(1000))
    rows = [(1, f'config token = "{value}" end', "src0"), (2, f"api_key: {value[:201]}", "src0")]
    found = op01_secrets.secret_findings(spark.createDataFrame(rows, "doc_id long, text string, source string"), op01_secrets.fit(spark)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.kind, r.value) for r in found) == [(1, 16, 1016, "assigned", value), (2, 9, 210, "assigned", value[:201])]


def test_margins_of_the_sample(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", lang, topic, int(rng.integers(1, 400) * (1, 1, 30)[i % 3] * big), 1) for i in range(12) for lang, big in (("en", 8), ("fr", 2), ("de", 1)) for topic in ("prose", "brief", "tabular")]
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    dims, work, budget = ["source", "lang", "topic"], Workspace(spark, "bounds"), 0.6
    cells, few = op04_mixing.rake(work, counted, dims, temper=0.7)
    got = op04_mixing.bound(work, cells, dims, budget, few).collect()
    total = sum(r.tokens for r in got)
    assert max(r.factor for r in got) * budget > 1 and all(0 <= r.p <= 1 for r in got)
    for d in dims:
        own, aim, kept = ({v: sum(x(r) for r in got if r[d] == v) for v in {r[d] for r in got}} for x in (lambda r: r.tokens, lambda r: r.tokens * r.factor, lambda r: r.tokens * r.p))
        # targets of values that have too few tokens go to the others in proportion
        whole: set = set()
        while True:
            level = (budget * total - sum(own[v] for v in whole)) / sum(aim[v] for v in own if v not in whole)
            more = {v for v in own if aim[v] * level >= own[v]}
            if more <= whole:
                break
            whole |= more
        for v in own:
            assert abs(kept[v] - (own[v] if v in whole else aim[v] * level)) < 5e-4 * total, (d, v, kept[v] / total)
    assert abs(sum(r.tokens * r.p for r in got) / total - budget) < 1e-3


def test_raking_tells_of_targets_that_contradict_each_other(spark):
    schema, work = "source string, lang string, topic string, tokens long, docs long", Workspace(spark, "apart")
    rows = [("s0", "en", "prose", 900, 1), ("s1", "fr", "prose", 50, 1), ("s2", "fr", "prose", 50, 1)]
    with pytest.warns(UserWarning, match="miss their targets"):
        op04_mixing.rake(work, spark.createDataFrame(rows, schema), ["source", "lang", "topic"])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        op04_mixing.rake(work, spark.createDataFrame([*rows, ("s1", "en", "prose", 70, 1)], schema), ["lang", "topic"])
