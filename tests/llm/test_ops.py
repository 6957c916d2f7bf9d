"""Training-data operators against brute force, round trips and held-out accuracy, on small and awkward inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewright.llm import chat, cutting_stock, html_text, near_dup, partenum, queries, toxicity
from tapewright.llm import resample as resampling
from tapewright.llm import words as W
from tapewright.llm.decontaminate import PIECE, decontaminate, find_contamination
from tapewright.llm.dom import Dom
from tapewright.llm.exact_dedup import exact_dedup, exact_groups
from tapewright.llm.html_text import LABELLED, extract_text, main_text, train
from tapewright.llm.licenses import CONTAINED, SHINGLE, TEMPLATES, license_matches, license_scan
from tapewright.llm.near_dup import near_duplicates
from tapewright.llm.packing import Encoder, pack_documents
from tapewright.llm.repeats import covered_bytes, remove_repeats
from tapewright.llm.resample import buckets_for, importance, largest, resample
from tapewright.llm.scratch import Scratch
from tapewright.llm.toxicity import fit, fold

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def frame(spark, rows, extra=True):
    """Documents with columns whose names operators use inside."""
    schema = "doc_id bigint, text string" + ", id string, node int, spans string, content string, n_words string, kept string" * extra
    return spark.createDataFrame([(*r, *(["x", 1, "y", "z", "w", "v"] * extra)) for r in rows], schema)


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Texts with copies, near copies, repeated rows, short and empty texts, nulls and other alphabets."""
    base = prose(120, 1)
    near = [" ".join(w if i % 60 != k else f"x{k}" for i, w in enumerate(base.split())) for k in range(4)]
    rows = [(1, base), (2, base.upper()), (3, near[0]), (4, near[1]), (5, near[2]), (6, near[3]), (7, prose(120, 2)), (8, "one two"), (9, "One  Two"), (10, ""), (11, None), (12, "  \n "), (13, "äöü ß 漢字 ÄÖÜ"), (14, "ÄÖÜ ß 漢字 ÄÖÜ")]
    rows += [(20, prose(3000, 3)), (21, prose(3000, 3) + " end"), (7, prose(120, 2)), (None, base), (None, "nobody's"), (30, "a" * 5000), (31, "solo")]
    return rows


# Words


def test_word_arrays():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\té漢'") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " "]
    import pyarrow as pa

    for kind, pattern in ((W.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (W.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for lo, data, offsets in W.slices(pa.array(texts)):
            starts, ends, before = W.spans(data, offsets, kind)
            for i, text in enumerate(texts[lo : lo + len(offsets) - 1]):
                got = [bytes(data[s:e]).decode() for s, e in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]], strict=True)]
                assert got == re.findall(pattern, text)
            found = W.hashes(data, starts, ends)
            names = [bytes(W.LOWER[data[s:e]]) for s, e in zip(starts, ends, strict=True)]
            assert len(set(found.tolist())) == len(set(names))


# 1


def components(rows, n, percent):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
        parent.setdefault(i, i)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: ([len(s) for s in sets[i]], find(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, awkward, n, percent):
    rng = random.Random(9)
    rows = [*awkward, (91, prose(50, 60)), (92, prose(50, 60)), (92, prose(50, 61)), (93, prose(50, 61) + " more"), (92, prose(50, 62))]
    for k in range(40):  # chains of edited copies
        words = prose(rng.choice([6, 15, 40, 90]), 100 + k % 6).split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((100 + k, " ".join(words)))
    got = near_duplicates(frame(spark, rows), shingle=n, percent=percent).collect()
    assert len(got) == len(rows)
    want = components(rows, n, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, n, c) for i, (sizes, c) in want.items() for n in sizes)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_join_of_a_large_group(spark):
    base = prose(60, 4).split()
    rng = random.Random(2)
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"z{rng.randrange(99)}" for w in base)) for i in range(700)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows, extra=False), shingle=4, percent=85).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 4, 85).items()}


def test_jaccard_join_places_a_document_once_for_each_centre(spark):
    """1,500 documents that share a centre and are not linked with it are one row each, not one for each block of 512."""
    tagged = spark.range(1500).select(F.lit(-1).cast("bigint").alias("centre"), F.col("id").alias("member"), F.lit(100).cast("bigint").alias("size"), F.col("id").alias("class"))
    assert near_dup._placed(tagged, Scratch(spark, "placed")).count() == 1500


@pytest.mark.parametrize("sides", [1, 2])
def test_jaccard_join_meets_in_tiles(monkeypatch, sides):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    kernels = [np.arange(k * 1000, k * 1000 + 10 + 20 * k, dtype=np.uint64) for k in range(5)]
    sets = []
    for k in range(70):
        own = kernels[k % 5].copy()
        at = rng.choice(len(own), rng.integers(0, 1 + len(own) // 6), replace=False)
        own[at] = rng.integers(10**6, 10**9, len(at))
        sets.append(np.unique(own))
    side, ids = np.arange(70) // 7 % sides, np.arange(70) * 3
    edges = near_dup._meet(ids, side, sets, 80)
    parts = lambda pairs: {i: min(c) for c in joined(70, pairs) for i in c}
    linked = [(i, j) for i, j in itertools.combinations(range(70), 2) if (sides == 1 or side[i] != side[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert len(edges) < 70 < len(linked)
    assert parts([(i // 3, j // 3) for i, j in edges]) == parts(linked)


def joined(n, pairs):
    groups = {i: {i} for i in range(n)}
    for i, j in pairs:
        both = groups[i] | groups[j]
        for k in both:
            groups[k] = both
    return list(groups.values())


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_partenum_guarantee(percent):
    rng = np.random.default_rng(3)
    assert partenum.levels(percent, 100) == (1 if percent == 80 else 3)
    for n in (5, 8, 20, 60, 300, 2000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            few = partenum.largest_difference(2 * n, percent, 100) // 2
            b = np.unique(np.concatenate([a[few // 2 :], rng.integers(0, 1 << 63, few - few // 2, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and shared < len(a):
                sigs, who = partenum.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent, 100)
                assert set(sigs[who == 0].tolist()) & set(sigs[who == 1].tolist())


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert near_duplicates(none).count() == exact_groups(none).count() == exact_dedup(none).count() == remove_repeats(none).count() == 0
    assert find_contamination(none, bench).count() == decontaminate(none, bench).count() == license_scan(none).count() == 0
    assert pack_documents(none, TOKENIZER).count() == resample(none, labels).count() == fit(none, labels).score(none).count() == 0
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# 2


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, awkward, keep):
    got = sorted((tuple(r) for r in exact_groups(frame(spark, awkward), keep=keep).collect()), key=repr)
    groups = defaultdict(list)
    for i, text in awkward:
        groups[lower(text)].append(i)
    best = {t: (min if keep == "min" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], sha(lower(t))) for i, t in awkward), key=repr)
    assert got == want
    left = exact_dedup(frame(spark, awkward), keep=keep)
    assert left.columns == frame(spark, awkward).columns
    assert {lower(r["text"]) for r in left.collect()} == set(groups)


# 3


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng.randrange(5, 80), i).split()
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) if i % 8 else f"lowe{rng.randrange(50)}")
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - int(toxic), int(toxic)))
    return rows, labels


def test_toxicity(spark, toxic_docs):
    rows, labels = toxic_docs
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (None, "idiot moron scum trash"), (3, "twice")])
    table = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    model = fit(docs, table)
    scored = model.score(docs).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    truth = {i: t for i, _, t in labels}
    held = [(r["score"] >= 0.5, truth[r["doc_id"]]) for r in scored if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    # Labels of the held-out fold change nothing.
    turned = table.withColumn("toxic", F.when(fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(map(key, fit(docs, turned).score(docs).collect())) == sorted(map(key, scored))
    # Without both classes there is nothing to fit.
    same = table.withColumn("toxic", F.lit(0))
    assert {r["score"] for r in fit(docs, same).score(docs).collect()} == {0.0}


def test_toxicity_features():
    """All features recomputed with plain Python."""
    import pyarrow as pa

    hashed = lambda words: np.sort(np.array([W.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words], dtype=np.uint64))
    lexicon = toxicity.Lexicon(hashed(["idiot", "scum"]), np.zeros(0, np.uint64))
    texts = ["", "You IDIOT, you scum!!! Why?", "a nice day (with 2 dogs) sooooo l8er c@t", "idiot " * 70 + "your", "Ünïcode ÉÉÉ du scum"]
    rows = []
    for text in texts:
        b = text.encode()
        words = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)]
        low = [lower(w.decode()) for w in words]
        hit = [w in ("idiot", "scum") for w in low]
        you = [w in toxicity.SECOND_PERSON for w in low]
        n, size = max(len(words), 1), max(len(b), 1)
        near = sum(h and any(you[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, h in enumerate(hit))
        alpha = lambda c: chr(c).isascii() and chr(c).isalpha() or c >= 0x80
        inside = sum(alpha(b[k - 1]) and alpha(b[k + 1]) and chr(b[k]) in "@#$%*_-.!|+" for k in range(1, len(b) - 1))
        digits = sum(alpha(b[k - 1]) and alpha(b[k + 1]) and chr(b[k]).isdigit() and b[k] < 0x80 for k in range(1, len(b) - 1))
        drawn = sum(alpha(b[k]) and b[k] == b[k - 1] == b[k - 2] for k in range(2, len(b)))
        upper = lambda w: sum(65 <= c <= 90 for c in w)
        rows.append([
            sum(hit) / n, np.log1p(sum(hit)), max([sum(hit[k : k + toxicity.WINDOW]) for k in range(len(hit))], default=0), 0, 0, near / n, sum(you) / n, upper(b) / size, sum(len(w) > 2 and upper(w) == len(w) for w in words) / n,
            b.count(b"!") / size, b.count(b"?") / size, sum(33 <= c < 127 and not chr(c).isalnum() for c in b) / size, inside / n, digits / n, drawn / n, np.log1p(len(words)),
        ])
    got = [x for _, data, offsets in W.slices(pa.array(texts)) for x in toxicity._features(data, offsets, lexicon)]
    assert len(toxicity.FEATURES) == len(rows[0]) and np.allclose(got, rows)


# 4


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "", "### User: </turn>\n", "\\\\", "<", "a\nb", "</turn>", " </turn>\n### Assistant: x", "é漢", "#" * 50]
    rng = random.Random(1)
    rows, turns = [], defaultdict(list)
    for c in range(30):
        for t in range(rng.randrange(1, 7)):
            role, text = rng.choice(["system", "user", "assistant", "### odd: ", "System", "?user", ""]), rng.choice([*texts, None])
            rows.append((c, t, role, text, 7))
            turns[c].append((role, text or ""))
    rows += [(40, 0, None, "x", 1), (None, None, "user", "y", 1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id int")
    got = {r["conv_id"]: r for r in chat.conversation_digests(table).collect()}
    for c, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert got[40]["problem"] and got[None]["n_turns"] == 1
    segments = defaultdict(list)
    for r in chat.format_turns(table).collect():
        segments[r["conv_id"]].append((r["position"], "".join(s["text"] for s in r["segments"])))
    for c, said in turns.items():
        whole, at, back = "".join(t for _, t in sorted(segments[c])), 0, []
        while at < len(whole):
            role, text, at = chat.read_turn(whole, at)
            back.append((role, text))
        assert back == said and len(whole) == got[c]["formatted_chars"]


def test_chat_order(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "system", "s")]
    got = {r["conv_id"]: r["problem"] for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {1: None, 2: "user after user at 1", 3: "ends with system"}


# 5


def test_encoder():
    encoder = Encoder(TOKENIZER)
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2027), 0x20AC, 0x6F22, 0x2603, 0x1F600]]
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext| >", "a  b", "don't  \n\n stop", "x   y"] + ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(" \n\ta1'") for _ in range(rng.randrange(1, 15))) for _ in range(3000)]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text).tolist() == want.ids


def check_packing(rows, got, capacity):
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0]).astype("<u4")
        for at in range(0, len(ids), capacity):
            want[i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(capacity - s for s in (sum(n for _, n in p) for p in filled.values()) if s & (s - 1)) / sum(r["length"] for r in got)


def test_packing(spark, awkward):
    rows = [*awkward, *((1000 + i, prose(random.Random(i).randrange(1, 400), i)) for i in range(300)), (2000, "a <|endoftext|> b"), (2001, prose(60_000, 9))]
    got = pack_documents(frame(spark, rows), TOKENIZER, with_ids=True).collect()
    assert check_packing(rows, got, 1024) < 0.03
    assert all(len(r["ids"]) == r["length"] for r in got)


def test_cutting_stock():
    rng = np.random.default_rng(0)
    for h in ({5: 3}, {1024: 7, 512: 3}, {int(k): int(v) for k, v in Counter(rng.integers(1, 1024, 1500).tolist()).items()}, {i: int(rng.integers(1, 300)) for i in range(1, 1025)}, {700: 9, 600: 4}):
        placed = Counter()
        for lengths, n in cutting_stock.cutting_stock(h, 1024):
            assert sum(lengths) <= 1024 and n > 0
            placed.update({s: 0 for s in lengths})
            for s in lengths:
                placed[s] += n
        assert placed == Counter(h)


def test_cutting_stock_reaches_the_optimum():
    # Two lengths that fill sequences only in pairs of two, one length three times, lengths that cannot be combined.
    for h, best in (({300: 2000, 212: 2000}, 1000), ({341: 3000}, 1000), ({700: 90, 600: 40}, 130), ({600: 100, 424: 100, 212: 200}, 150)):
        assert sum(n for _, n in cutting_stock.cutting_stock(h, 1024)) == best


def test_linear_program_reaches_its_bound():
    """Hundreds of lengths, most of them rare: the program ends by itself within one sequence of its bound."""
    rng = random.Random(17)
    for n in (300, 1500):
        h = Counter(min(1 + int(rng.expovariate(1 / 260)), 1023) for _ in range(n))
        sizes = np.array(sorted(h))
        columns, count, least = cutting_stock.relaxed(sizes, np.array([h[s] for s in sizes.tolist()], dtype=float), 1024)
        assert count.sum() - least <= 1 and (columns.T @ sizes <= 1024).all()
        plan = cutting_stock.cutting_stock(h, 1024)
        placed = Counter()
        for lengths, times in plan:
            placed.update({s: k * times for s, k in Counter(lengths).items()})
        assert placed == h and sum(times for _, times in plan) <= math.ceil(least) + 2


def test_column_generation_against_all_patterns():
    """The linear program over every pattern there is, by its dual: no prices that all patterns accept are worth more than the bound."""
    rng = random.Random(3)
    for capacity in (9, 12, 17):
        for _ in range(10):
            sizes = sorted(rng.sample(range(2, capacity), rng.randrange(1, 5)))
            demand = np.array([rng.randrange(1, 40) for _ in sizes], dtype=float)
            price = np.array([rng.random() for _ in sizes])
            patterns = [p for p in itertools.product(*(range(capacity // s + 1) for s in sizes)) if sum(a * b for a, b in zip(p, sizes)) <= capacity]
            found, value = cutting_stock.best_pattern(np.array(sizes), price, capacity)
            assert abs(value - max(np.dot(p, price) for p in patterns)) < 1e-9 and abs(found @ price - value) < 1e-9 and found @ sizes <= capacity
            basis, count, least = cutting_stock.relaxed(np.array(sizes), demand, capacity, gap=0.0)
            assert np.allclose(basis @ count, demand) and (count >= 0).all()
            assert abs(count.sum() - least) < 1e-6 * least


# 6


def test_resample(spark):
    rng = random.Random(3)
    rows = [(i, prose(60, i, 50) if i % 2 else " ".join(f"q{rng.randrange(50)}" for _ in range(60))) for i in range(600)] + [(9000, None), (None, "q1 q2")]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0, 400)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = resample(frame(spark, rows), labels, share=0.3).collect()
    kept = [r for r in got if r["kept"]]
    assert len(got) == len(rows) and len(kept) == int(len(rows) * 0.3)
    assert sum(r["doc_id"] is not None and r["doc_id"] % 2 == 0 for r in kept) / len(kept) > 0.95
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    table = spark.createDataFrame([(k,) for k in keys], "gumbel_key double")
    for k in (1, 2, 100, len(keys)):
        assert largest(table, "gumbel_key", k) == keys[k - 1]
    assert largest(table, "gumbel_key", len(keys) + 1) is None
    # Weights against a plain count.
    target = [t for i, t in rows if i is not None and i < 400 and i % 2 == 0 and zlib.crc32(str(i).encode()) % 5]
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:]))
    a, b = Counter(g for t in target for g in grams(t)), Counter(g for _, t in rows for g in grams(t))
    buckets = 1 << 20
    one = importance(frame(spark, rows), labels, buckets=buckets).where("doc_id = 2").first()
    mean = importance(frame(spark, rows), labels, buckets=buckets, unit=100.0).where("doc_id = 2").first()
    assert abs(mean["log_weight"] - one["log_weight"] * 100 / len(grams(rows[2][1]))) < 1e-3
    plain = sum([np.log((a[g] + 1) / (sum(a.values()) + buckets)) - np.log((b[g] + 1) / (sum(b.values()) + buckets)) for g in grams(rows[2][1])])
    assert abs(one["log_weight"] - plain) < 0.02 * abs(plain)  # buckets collide now and then


def test_counts_and_ratios_in_parts(monkeypatch):
    """Counts that are added up many times, and blocks that go over batches, against plain arrays."""
    monkeypatch.setattr(resampling, "_SETTLE", 50)
    monkeypatch.setattr(resampling, "_SENT", 50)
    monkeypatch.setattr(resampling, "BLOCK", 16)
    rng = random.Random(23)
    texts = [None, "", *(" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(40))) for _ in range(60))]
    flags = [rng.random() < 0.3 for _ in texts]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 7], pa.string()), "wanted": flags[i : i + 7]}) for i in range(0, len(texts), 7)]
    buckets = 1 << 9
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for text, flag in zip(texts, flags, strict=True):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        bucket, _ = resampling._grams(data, np.array([0, len(data)]), buckets)
        np.add.at(raw, bucket, 1), np.add.at(target, bucket, int(flag))
    out = list(resampling._counted(buckets)(iter(batches)))
    got = pa.Table.from_batches(out).sort_by("bucket")
    assert len(out) > 1 and got["bucket"].to_pylist() == np.flatnonzero(raw).tolist()
    assert np.array_equal(got["raw"].to_numpy(), raw[raw > 0]) and np.array_equal(got["target"].to_numpy(), target[raw > 0])
    assert sum(len(b) for b in resampling._counted(buckets)(iter([]))) == 0
    ratio = np.zeros(buckets, dtype=np.float32)
    seen = []
    for b in resampling._ratios(int(raw.sum()), int(target.sum()), buckets, 1.0)(iter(got.combine_chunks().to_batches(max_chunksize=11))):
        for block, packed in zip(b["block"].to_pylist(), b["ratios"].to_pylist(), strict=True):
            seen.append(block)
            ratio[block * 16 : block * 16 + 16] = np.frombuffer(packed, dtype=np.float32)
    plain = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    assert len(seen) == len(set(seen)) and np.allclose(ratio[raw > 0], plain[raw > 0], atol=1e-5)


def test_bounded_target(spark):
    """The rows of the least hashes, the same with and without what is left out before."""
    ids = spark.range(50_000).select(F.col("id").alias("label_id"))
    plain = sorted(r[0] for r in ids.orderBy(F.xxhash64("label_id"), "label_id").limit(5000).collect())
    assert sorted(r["label_id"] for r in resampling._least_hashes(ids, "label_id", 5000).collect()) == plain
    assert resampling._least_hashes(ids, "label_id", 60_000).count() == 50_000


def test_resample_against_a_plain_model(spark):
    """Every weight and key of a table with ties, nulls and repeated rows, and what is kept."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("a b c d e f".split() if i % 3 else "x y z a".split()) for _ in range(rng.randrange(9)))) for i in range(120)] + [(7, "a b"), (7, "a b"), (None, "x"), (None, None)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(0, 120, 2)]
    got = resample(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), share=0.4).collect()
    buckets = buckets_for(sum(len((t or "").encode()) for _, t in rows))
    assert buckets == 1 << 14 and buckets_for(10**9) == 1 << 19 and buckets_for(10**15) == 1 << 24
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:]))
    good = {i for i, q, _ in labels if q and zlib.crc32(str(i).encode()) % 5}
    a, b = Counter(g for i, t in rows if i in good for g in grams(t)), Counter(g for _, t in rows for g in grams(t))
    weight = lambda t: float(sum(np.log((a[g] + 1) / (sum(a.values()) + buckets)) - np.log((b[g] + 1) / (sum(b.values()) + buckets)) for g in grams(t)))
    assert np.allclose(sorted(r["log_weight"] for r in got), sorted(weight(t) for _, t in rows), atol=1e-3)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    least = keys[int(len(rows) * 0.4) - 1]
    assert all(r["kept"] == (r["gumbel_key"] >= least) for r in got)
    twice = [(r["gumbel_key"], r["kept"]) for r in got if r["doc_id"] == 7]
    assert len(twice) == 3 and max(twice.count(x) for x in twice) >= 2


# 7


def test_html():
    model = train()
    for page in LABELLED:
        dom, label = html_text._labelled(page)
        main = " ".join(dom.text[k] for k in range(len(label)) if dom.tag[k] == "#text" and label[k])
        assert ("Rain fell on the hills" in main_text(page, model)) == ("Rain fell on the hills" in main)
    assert "Buy two" not in main_text(LABELLED[0], model) and "cookies" not in main_text(LABELLED[2], model)
    page = '<html><head><title>no</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; tail</h1><p>One\n two <b>thr</b>ee.<p>Four&nbsp;&lt;5<script>x("</p>")</script></article><footer>&copy; no</footer></body></html>'
    assert main_text(page, model) == "Head & tail One two three. Four <5"
    for odd in (None, "", "<", "<p", "<!-- open", "</div></div>", "<div" * 500, "a" * 100_000):
        assert isinstance(main_text(odd, model), str)


def test_html_without_names():
    """Pages without class names or sectioning tags, of other words than the labelled ones."""
    model = train()
    first = "Bread is baked at night in the old town, and by six in the morning the smell has reached the harbour and the ships that lie there."
    second = "Few of the bakers are left now. Those who are do not think of stopping, and their children have begun to learn the trade."
    pages = (
        f"<div>Home About Contact</div><div><h1>Bread</h1><p>{first}<p>{second}</div><div>All rights reserved</div>",
        f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Bread</h1><p>{first}</p><p>{second}</p></div><div>Copyright 2021. All rights reserved.</div></body>",
        f"<table><tr><td><a href=/>Home</a> | <a href=/c>Contact</a></td></tr><tr><td><h1>Bread</h1><p>{first}</p><p>{second}</p></td></tr></table>",
    )
    for page in pages:
        assert main_text(page, model) == f"Bread {first} {second}", page


def test_training_weights_left_out_pages():
    known = [html_text._labelled(page) for page in LABELLED]
    wrong = total = 0
    for k, (dom, label) in list(enumerate(known))[::3]:
        model = train(LABELLED[:k] + LABELLED[k + 1 :])
        for node, odds in enumerate(html_text.marginals(dom, model)):
            if dom.tag[node] == "#text" and (n := len(dom.text[node].strip())):
                wrong, total = wrong + n * ((odds >= 0) != label[node]), total + n
    assert wrong < 0.15 * total


def test_html_that_leaves_out_end_tags():
    model = train()
    text = "Rain fell on the hills for nine days, and the river rose until it reached the mill."
    article = f"<article><h1>High water</h1><p>{text}</article>"
    pages = (
        f"<html><head><title>T</title><body>{article}</html>",
        f"<head><meta charset=utf-8><style>p {{}}</style>\n{article}",
        f"<html><head><title>T</title><noscript><p>Turn scripts on.</p></noscript><script>x()</script>\n<body>{article}",
        f"<html><head><title>T</title></head><body>{article}",
        f"<article><h1>High <svg/>water</h1><svg viewBox='0 0 1 1'><path d='M0'/><g/></svg><svg><path d='M0'><p>{text}</article>",
        f"<article><h1>High water</h1><iframe src='a'/><iframe src='b'></iframe><object data='c'/><p>{text}</article>",
        f"<article><h1>High water</h1><svg><foreignObject><p>not shown</p></foreignObject><title>nor this</title></svg><p>{text}</article>",
    )
    for page in pages:
        assert main_text(page, model) == f"High water {text}", page
    assert Dom(f"<head><title>no</title>{text}").text[-1] == text


def test_extract(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    import html

    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S).group(1)
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"</?([a-z0-9]+)[^>]*>", lambda m: "" if m[1] == "b" else " ", inner)).split())
    assert {r["page_id"]: r["text"] for r in extract_text(pages.withColumn("text", F.lit("clash"))).collect()} == want


# 8


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    long = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, prose(500, 1) + f"\n{mit}\n" + prose(300, 2)), (2, gpl.upper() + " " + mit), (3, "released under the license"), (4, None), (5, ""), (6, prose(40, 3) + " " + long.replace("may", "can").replace("endorse", "back").replace("products", "goods") + " " + prose(40, 4))]
    rows += [(7, prose(9, 5) + " " + long + " x"), (None, mit), (8, "mit " * 3000), (2, prose(5, 1))]
    got = sorted(((r["doc_id"], r["licenses"], r["n_licenses"]) for r in license_scan(frame(spark, rows)).collect()), key=repr)
    want = {1: "MIT", 2: "GPL-3.0,MIT", 7: "BSD-3-Clause", None: "MIT"}
    assert got == sorted(((i, want.get(i, ""), want.get(i, "").count(",") + (i in want)) for i, _ in rows), key=repr)
    found = {(r["doc_id"], r["license"]): r["contained"] for r in license_matches(frame(spark, rows)).collect()}
    assert found[7, "BSD-3-Clause"] == 1.0


def test_whole_licence_texts_and_tags(spark):
    """Whole texts of short licences, and tags with what stands around them; the names are written here, not taken from the templates."""
    intro = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    one = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    two = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    three = "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    end = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.'
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    tag = "SPDX-License-Identifier: "
    cases = [
        (intro + one + two + end, "BSD-2-Clause"),
        (intro + one + two + three + end, "BSD-3-Clause"),
        (intro, ""),
        (mit, "MIT"),
        (isc, "ISC"),
        (mit + "\n" + intro + one + two + end, "BSD-2-Clause,MIT"),
        (tag + "MIT", "MIT"),
        (f"# {tag.lower()}mit.\n", "MIT"),
        (tag + "MIT-0", ""),
        (tag + "ISC\n" + tag + "Unlicense", "ISC,Unlicense"),
        (tag + "GPL-2.0-or-later", "GPL-2.0"),
        (tag + "LGPL-2.1+", "LGPL-2.1"),
        (tag + "MPL-2.0\n" + tag + "MPL-2.0", "MPL-2.0"),
        ("xspdx-license-identifier: MIT", ""),
        ("SPDX License Identifier", ""),
    ]
    for around in ("", prose(120, 9)):
        rows = [(i, f"{around}\n{text}\n{around}") for i, (text, _) in enumerate(cases)] + [(None, tag + "MIT"), (99, None)]
        got = {r["doc_id"]: r["licenses"] for r in license_scan(frame(spark, rows)).collect()}
        assert got == {**{i: name for i, (_, name) in enumerate(cases)}, None: "MIT", 99: ""}


def test_creative_commons_and_gnu_licenses(spark):
    texts = {
        "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
        "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        "CC-BY-SA-4.0": ("This page is available under a CC BY-SA 4.0 license.",),
        "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
        "CC-BY-NC-SA-3.0": ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License",),
        "CC-BY-NC-ND-2.5": ("the Creative Commons Attribution-Noncommercial-No Derivative Works 2.5 License",),
        "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0",),
        "LGPL-2.1": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",),
        "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",),
        "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
        "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    }
    cases = [(name, text) for name, found in texts.items() for text in found]
    rows = [(i, f"{prose(200, i)}\n{text}\n{prose(90, 50 + i)}") for i, (_, text) in enumerate(cases)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(frame(spark, rows)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}


def test_license_templates_tell_licences_apart():
    shingled = lambda text: {tuple(w[i : i + SHINGLE]) for w in [re.findall("[a-z0-9]+", lower(text))] for i in range(len(w) - SHINGLE + 1)}
    known = [(name, shingled(text)) for name, texts in TEMPLATES.items() for text in texts]
    assert all(shingles for _, shingles in known)
    for name, shingles in known:
        assert {other for other, its in known if len(its & shingles) >= CONTAINED * len(its)} == {name}


# 9


def removed(rows, length):
    count = Counter(t.encode()[k : k + length] for _, x in rows for t in [x or ""] for k in range(len(t.encode()) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, awkward, seed):
    rng = random.Random(seed)
    passages = [prose(rng.randrange(60, 140), 500 + k) for k in range(5)] + ["ab" * 600, "é" * 300]
    rows = list(awkward)
    for k in range(60):
        rows.append((200 + k, " ".join(prose(rng.randrange(1, 60), 900 + 100 * seed + k) if rng.random() < 0.6 else rng.choice(passages)[rng.randrange(20) :] for _ in range(rng.randrange(1, 6)))))
    docs = frame(spark, rows).repartition(5)
    for length in (400, 150):
        spans = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_byte"] - s["first_byte"])
        got = remove_repeats(docs, length=length, with_kept=True)
        kept = sorted(((r["doc_id"], r["n_bytes"], r["removed"], len(r["spans"]), r["kept_sha256"]) for r in got.withColumn("removed", spans).collect()), key=repr)
        assert kept == removed(rows, length)
        assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got.collect())


def test_passages_shorter_than_what_is_removed(spark, awkward):
    rng = random.Random(4)
    passages = [prose(rng.randrange(40, 70), 300 + k) for k in range(4)]
    rows = [*awkward] + [(400 + k, " ".join([prose(30, 4000 + k), rng.choice(passages), prose(40, 5000 + k)])) for k in range(40)]
    for rows_ in (rows, []):
        docs = frame(spark, rows_).repartition(4)
        got = remove_repeats(docs, length=300, passage=200).withColumn("removed", covered_bytes(F.col("spans"))).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["removed"], len(r["spans"]), r["kept_sha256"]) for r in got), key=repr) == removed(rows_, 300)
        assert sorted(((r["doc_id"], r["n_bytes"], r["passage_bytes"]) for r in got), key=repr) == sorted((r[:3] for r in removed(rows_, 200)), key=repr)


def test_repeats_in_many_batches(spark):
    """A family of near copies over several Arrow batches of a task, and a text much longer than a slice of words."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng, base = random.Random(6), prose(150, 6).split()
        rows = [(k, " ".join(w if rng.random() > 0.01 else f"z{rng.randrange(999)}" for w in base)) for k in range(60)]
        rows += [(100, prose(250_000, 7)), (101, prose(250_000, 7)[700_000:703_000]), (102, prose(100, 8))]
        got = remove_repeats(frame(spark, rows).repartition(3), length=400).withColumn("removed", covered_bytes(F.col("spans"))).collect()
        mine = {r["doc_id"]: (r["removed"], len(r["spans"]), r["kept_sha256"]) for r in got}
        small = [r for r in rows if r[0] != 100]
        want = {i: x for i, _, *x in removed(small, 400)}
        assert mine[100][:2] == (3000, 1) and mine[101][:2] == (3000, 1) and mine[102][0] == 0
        assert {i: list(x) for i, x in mine.items() if i < 100} == {i: x for i, x in want.items() if i < 100}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_of_texts_whose_32_bit_hashes_are_equal(spark):
    shared, own = prose(80, 7001), prose(110, 7002)
    rows = [(None, f"a4949 {shared}"), (None, f"b65682 {own}"), (1, f"{shared} end")]
    docs = frame(spark, rows)
    assert docs.where("doc_id is null").select(F.hash("text")).distinct().count() == 1
    spans = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_byte"] - s["first_byte"])
    got = remove_repeats(docs, length=150).withColumn("removed", spans).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["removed"], len(r["spans"]), r["kept_sha256"]) for r in got), key=repr) == removed(rows, 150)


# 10


def contaminated(rows, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= {str(y) for y in x if y is not None}
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination(spark, awkward, block):
    items = [(1, prose(30, 77)), (2, prose(30, 77)), (10, "Just four words HERE"), (3, ""), (4, None), (None, prose(12, 78)), (5, "ÄÖÜ ß 漢字 ÄÖÜ")]
    rows = [*awkward, (50, "a, " + prose(30, 77).replace(" ", ", ").upper() + " z"), (51, "x just four-words here y"), (52, " ".join(prose(30, 77).split()[:9])), (53, prose(12, 78)), (54, "é" + prose(30, 77) + " tail")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    got = find_contamination(docs, bench, block_bytes=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end_word"] - s["first_word"] for s in r["spans"]), r["items"]) for r in got), key=repr) == contaminated(rows, items, 10)
    clean = decontaminate(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _, hit, _ in contaminated(rows, items, 10) if not hit), key=repr)
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench, remove="spans", block_bytes=block).collect()}
    assert cut[50] == "a,  z" and cut[51] == "x  y" and cut[54].startswith("é") and cut[54].endswith("tail") and cut[11] is None


def test_long_benchmark_items(spark):
    """An item of many pieces, larger than a block, whose windows cross the borders of pieces."""
    long = prose(150_000, 31, vocabulary=10**6)
    words = long.split()
    items = [(1, long), (2, prose(40, 32))]
    rows = [(1, " ".join(words[PIECE - 6 : PIECE + 7])), (2, " ".join(words[140_000:140_009])), (3, prose(40, 32)), (4, "x " + " ".join(words[2 * PIECE : 2 * PIECE + 10]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (16 << 20, 300_000):
        got = find_contamination(frame(spark, rows), bench, block_bytes=block).collect()
        assert sorted((r["doc_id"], sum(s["end_word"] - s["first_word"] for s in r["spans"]), r["items"]) for r in got) == [(1, 13, ["1"]), (2, 0, []), (3, 40, ["2"]), (4, 10, ["1"])]


# Queries


def test_native_queries_run_no_python(spark, data):
    for name in ("op2_exact_dedup", "op8_license_scan"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", plan)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    result = queries.queries()[name](spark, data)
    columns = sorted(result.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(str(row[c]) for c in columns) for row in result.collect()) == want
