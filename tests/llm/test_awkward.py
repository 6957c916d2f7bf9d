"""Very long texts, and pipeline stages on tables with nulls, repeated rows, clashing names or no rows."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from tapewright.llm import chat, queries
from tapewright.llm import words as W
from tapewright.llm.decontaminate import find_contamination
from tapewright.llm.exact_dedup import exact_groups
from tapewright.llm.html_text import extract_text
from tapewright.llm.licenses import license_scan
from tapewright.llm.near_dup import near_duplicates
from tapewright.llm.packing import pack_documents
from tapewright.llm.repeats import remove_repeats
from tapewright.llm.resample import resample
from tapewright.llm.toxicity import fit
from tests.llm.test_ops import TOKENIZER, check_packing, frame, prose, sha, toxic_docs  # noqa: F401

NOTICE = "Released under the MIT License."


@pytest.fixture(scope="module")
def long_rows():
    """Texts of several slices of ``words``: one, its copy in capitals, an edited copy with a notice at its end, another."""
    long, other = prose(400_000, 5, vocabulary=10**6), prose(250_000, 6, vocabulary=10**6)
    assert len(long) > 2 * W.SLICE
    words = long.split()
    words[::50] = ["edited"] * len(words[::50])
    return [(1, long), (2, long.upper()), (3, " ".join(words) + "\n" + NOTICE), (4, other), (5, "short")]


def test_long_texts_of_pairs_and_groups(spark, long_rows):
    docs = frame(spark, long_rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, shingle=4, percent=85).collect()}
    # Every fiftieth word edited leaves 92 % of the shingles equal: 0.85 of the union.
    shingles = {i: {tuple(w[k : k + 4]) for w in [t.lower().split()] for k in range(max(1, len(w) - 3))} for i, t in long_rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(s) for i, s in shingles.items()}
    linked = 100 * len(shingles[1] & shingles[3]) >= 85 * len(shingles[1] | shingles[3])
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1 if linked else 3, 4: 4, 5: 5}
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_groups(docs).collect()}
    assert groups[1] == groups[2] and groups[1][1:] == (2, sha(long_rows[0][1])) and groups[4] == (4, 1, sha(long_rows[3][1]))


def test_long_texts_of_repeats_and_windows(spark, long_rows):
    first, _, third, other, short = (t for _, t in long_rows)
    # The first text again, but for its last word.
    rows = [(1, first), (2, first.rsplit(" ", 1)[0] + " end"), (4, other), (5, short)]
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in remove_repeats(frame(spark, rows)).collect()}
    same = next(k for k in range(len(first)) if first[k] != rows[1][1][k])
    assert got == {1: (len(first), [(0, same)]), 2: (len(rows[1][1]), [(0, same)]), 4: (len(other), []), 5: (5, [])}
    item = " ".join(other.split()[-12:])
    bench = spark.createDataFrame([(1, item), (2, prose(30, 99))], "item_id bigint, text string")
    hits = {r["doc_id"]: (r["n_words"], [(s["first_word"], s["end_word"]) for s in r["spans"]], r["items"]) for r in find_contamination(frame(spark, long_rows), bench).collect()}
    assert hits[4] == (250_000, [(249_988, 250_000)], ["1"]) and hits[1][0] == 400_000 and not hits[1][2]
    assert {r["doc_id"]: r["licenses"] for r in license_scan(frame(spark, long_rows)).collect()} == {1: "", 2: "", 3: "MIT", 4: "", 5: ""}


def test_long_texts_of_models_and_formats(spark, long_rows, toxic_docs):  # noqa: F811
    rows, labels = toxic_docs
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ids = [(10_000 + i, t) for i, t in long_rows]
    insult = " ".join(["idiot moron scum trash"] * 150_000)
    docs = frame(spark, [*rows, *ids, (20_000, insult)])
    scores = {r["doc_id"]: r["score"] for r in fit(docs, labels).score(docs).collect()}
    assert len(scores) == len(rows) + len(ids) + 1 and scores[20_000] >= 0.5 and scores[10_001] < 0.5
    kept = resample(docs, labels, share=0.5).collect()
    assert len(kept) == docs.count() and sum(r["kept"] for r in kept) == len(kept) // 2
    some = [(4, long_rows[3][1]), (5, "short"), (5, None)]
    assert check_packing(some, pack_documents(frame(spark, some), TOKENIZER).collect(), 1024) < 1
    said = [("user", "short"), ("assistant", long_rows[3][1] + " </turn>")]
    turns = spark.createDataFrame([(1, k, role, text) for k, (role, text) in enumerate(said)], "conv_id bigint, turn bigint, role string, text string")
    told = chat.conversation_digests(turns).first()
    assert (told["n_turns"], told["loss_chars"], told["loss_sha256"]) == (2, len(said[1][1]), sha(said[1][1]))
    page = f"<html><body><nav><a href=/>Home</a></nav><article><p>{long_rows[3][1]}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert extract_text(pages).first()["text"] == long_rows[3][1]


def tables(spark, folder, labels, items):
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_awkward_rows(spark, toxic_docs, tmp_path):  # noqa: F811
    rows, labels = toxic_docs
    base, leak = prose(120, 1), prose(30, 77)
    tables(spark, tmp_path, labels, [(1, leak), (None, "odd words of one"), (2, None), (3, "")])
    added = [(None, None), (None, ""), (2000, None), (2001, base), (2001, base), (2002, base.upper()), (2003, base + " more"), (None, "x " + leak + " y"), (2004, leak), (None, "idiot moron scum trash"), (2005, "ÄÖÜ ß 漢字"), (2006, "odd words of one thing")]
    docs = frame(spark, [*rows, *added])
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
            seen[name] = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            assert not seen[name] - Counter((r["doc_id"], r["text"]) for r in before.collect())
    clean = Counter(x for x in added if x[1] != "idiot moron scum trash")
    assert clean <= seen["toxicity"] and (None, "idiot moron scum trash") not in seen["toxicity"]
    exact = seen["exact dedup"]
    # Rows that repeat id and text all stay here; the next stage leaves one of them.
    assert [(i, n) for (i, t), n in exact.items() if (t or "").lower() == base] == [(2001, 2)] and [i for i, t in exact.elements() if not t] == [2000]
    near = seen["n-gram jaccard join"]
    assert [i for i, t in near.elements() if (t or "").lower().startswith(base)] == [2001]
    last = seen["benchmark decontamination"]
    assert near - last == Counter({x: n for x, n in near.items() if x[1] and (leak in x[1] or "odd words of one" in x[1])})
    check_packing([x for x, n in last.items() for _ in range(n)], docs.collect(), 1024)


def test_stages_on_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    # Documents without labels or benchmark: nothing is toxic, nothing leaks.
    docs = frame(spark, [(1, prose(30, 1)), (2, prose(30, 2)), (None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).count() == 3, name


def test_queries_name_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries()) == list(range(1, 14))
