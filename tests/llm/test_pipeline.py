"""The corpus pipeline on the smallest tables: every stage against brute force on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_ops import check_packing, components, contaminated, frame, lower, prose, toxic_docs  # noqa: F401


def test_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            check_packing(list(before.items()), out.collect(), 1024)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after) and after.items() <= before.items()
        if name == "toxicity":
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in clean) / len(clean) > 0.95
        elif name == "exact dedup":
            first = defaultdict(list)
            for i, t in before.items():
                first[lower(t)].append(i)
            assert set(after) == {min(x) for x in first.values()}
        elif name == "n-gram jaccard join":
            assert set(after) == {i for i, (_, c) in components(list(before.items()), 5, 80).items() if i == c}
        else:
            assert set(after) == {i for i, _, hit, _ in contaminated(list(before.items()), items, 10) if not hit}
        docs = out


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(re.fullmatch(r"\d+", str(r["sequence_id"])) for r in rows)


def test_toxic_rows_without_an_id_or_with_a_shared_id(spark, toxic_docs, tmp_path):  # noqa: F811
    rows, labels = toxic_docs
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    insult, clean = "idiot moron scum trash", prose(40, 1)
    docs = frame(spark, [*rows, (None, insult), (None, clean), (5000, insult), (5000, clean)])
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert [x for x in kept if x[1] in (insult, clean) and x[0] in (None, 5000)].count((5000, clean)) == kept.count((None, clean)) == 1
    assert (None, insult) not in kept and (5000, insult) not in kept


def test_near_copies_without_an_id_or_with_a_shared_id(spark):
    base, other = prose(120, 1), prose(120, 2)
    rows = [(None, base + " a"), (7, base + " b"), (3, base + " c"), (None, other + " a"), (None, other + " b"), (None, None), (None, None), (9, prose(90, 3)), (9, prose(90, 4)), (None, "short")]
    docs = frame(spark, rows)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert [x for x in kept if x[1] and x[1].startswith(other)] in ([rows[3]], [rows[4]])
    assert [x for x in kept if not (x[1] and x[1].startswith(other))] == sorted([rows[2], *rows[5:]], key=repr)
