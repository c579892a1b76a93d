import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from concord.llm import decontaminate, langid, pieces, secrets
from concord.llm.queries import ORACLES, QUERIES
from concord.session import materialize

from .cases import odd
from .test_secrets import linked_by_gaps
from .test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_equals_plain_code(spark, docs):
    """The stages as plain Python over the same rows (the fitted classifier is the operator's)."""
    model = langid.fit(docs)
    rows = docs.orderBy("doc_id").collect()
    _, _, no = model.predict([r["text"] for r in rows])
    rows = [r for r, x in zip(rows, no) if not x]
    group = {f: k for k, g in enumerate(plain_groups(list({plain_fingerprint(r["text"]) for r in rows}))) for f in g}
    seen, left = set(), []
    for r in rows:
        if (g := group[plain_fingerprint(r["text"])]) not in seen:
            seen.add(g)
            left.append(r)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    needles = decontaminate.index(items)
    left = [r for r in left if not any(t in r["text"] for _, t in items)]
    assert all(not decontaminate.find_leaks([r["text"]], needles)[0] for r in left)
    p = pieces.load(pieces.read_model())
    want = {}
    for r in left:
        text, spans = r["text"], [s.split(":") for s in linked_by_gaps(r["text"]).split(",") if s]
        out, at = "", 0
        for _, a, b in spans:
            if int(a) >= at:
                out += text[at: int(a)] + secrets.MASK
            at = max(at, int(b))
        want[r["doc_id"]] = out + text[at:]
    got = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        assert p.decode(r["ids"]) == want[r["doc_id"]]
        (raw, score, _), = p.encode([want[r["doc_id"]]])
        assert r["score"] == score and r["ids"] == raw and r["n_pieces"] == len(r["ids"])


def test_stages_keep_columns_and_take_odd_rows(spark, docs):
    extra = odd(spark).select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"),
                                                             "n_chars": F.length("text").cast("bigint"), "score": F.lit(1)})
    part = docs.withColumn("score", F.lit(2)).unionByName(extra)
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, part, SF), "test")
        assert out.columns == part.columns, name
        part = out
    assert P.STAGES[-1][1](spark, part, SF).count() == part.count()
    assert part.where("text is null").count() == 0


def test_stages_on_an_empty_table(spark, docs):
    none = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(P.STAGES) <= 5
