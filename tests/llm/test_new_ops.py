"""URL rules, conversation repair and whitening against brute force, on given tables and awkward inputs."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

import public_tokenizers
from tapewright.llm import queries, whitening
from tapewright.llm.dom import Dom
from tapewright.llm.html_text import main_text, train
from tapewright.llm.packing import Encoder, pack_documents
from tapewright.llm.repair import Codes, align, repair_conversations
from tapewright.llm.url_rules import Ranges, judge_urls


# URL rules


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def compare_urls(spark, pages, rules):
    rows = spark.createDataFrame(pages, "page_id bigint, url string, key string, host string, at int, verdict string")
    got = judge_urls(rows, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = sorted((repr((p[0], *judged(p[1], rules))) for p in pages))
    assert sorted(repr(tuple(r)) for r in got) == want


def test_url_rules_on_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()
    want = sorted((p["page_id"], *judged(p["url"], queries.URL_RULES)) for p in pages)
    got = sorted(tuple(r) for r in queries.op13_url_rules(spark, data).collect())
    assert [repr(r) for r in got] == [repr(r) for r in want] and {r[4] for r in got} == {"allow", "block"}


def test_url_rules_nested_and_awkward(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "aa", "a-b", "net", "", "é"], ["/", "/a", "/a/", "/a/b", "/ab", "", "/é", "/a/b/c", "/A"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice(parts)) for _ in range(300))}.values())
    rules += [(h, p, "block" if v == "allow" else "allow") for h, p, v in rules[:30]] + [(None, "/", "block"), ("net", None, "allow")]
    urls = [f"{rng.choice(['http', 'x'])}://{host()}{rng.choice(parts)}{rng.choice(parts)}{rng.choice(['', '?q=/a', '#/b', ':80/'])}" for _ in range(2000)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://A.NET/A", "a://b://a.net/", "http://a.net?x/", "http://net.", "http://.net/", "x://a.net/" + "y" * 300_000, "x://" + "a." * 3000 + "net/a", "x://a\n.net/a\nb"]
    pages = [(k, u, "k", "h", 1, "v") for k, u in enumerate(urls)] + [(None, u, None, None, None, None) for u in urls[:20]] * 2
    compare_urls(spark, pages, rules)
    compare_urls(spark, [], rules)
    none = spark.createDataFrame([("a.net", "/", None), ("net", "", "other")], "host string, path string, verdict string")
    assert {(r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string"), none).collect()} == {(None, "allow")}


def test_url_rules_with_one_hot_url_and_one_hot_host(spark):
    # A third of all rows is one url, another third one host: both fill several ranges.
    pages = [(k, "http://m.hot.com/de/1", "", "", 0, "") for k in range(1500)] + [(k, f"http://one.org/{k % 700}/x", "", "", 0, "") for k in range(1500)] + [(k, f"http://h{k}.net/", "", "", 0, "") for k in range(1500)]
    rules = [("com", "/", "block"), ("hot.com", "/de/", "allow"), ("org", "/1", "block"), *[("one.org", f"/{k}/", "block") for k in range(0, 700, 3)], ("net", "", "block")]
    compare_urls(spark, pages, rules)
    long = "http://m.hot.com/" + "d" * 3000
    compare_urls(spark, [(k, long, "", "", 0, "") for k in range(400)] + pages[:100], [("hot.com", "/" + "d" * 2000, "block"), ("hot.com", "/" + "d" * 4000, "block"), ("a." * 900 + "hot.com", "/", "block")])


def test_ranges_hold_all_that_a_rule_fits():
    rng = random.Random(5)
    keys = ["net.", "net.a.", "net.a.b.", "net-a.", "org.", "com.x.", "neta."]
    paths = ["", "/", "/a", "/a/b", "/b", "/c/d"]
    for _ in range(300):
        ranges = Ranges(sorted((rng.choice(keys), rng.choice(paths)) for _ in range(rng.randrange(0, 9))))
        for key, path, rule_key, rule_path in itertools.product(keys, paths, keys, paths):
            if key.startswith(rule_key) and path.startswith(rule_path):
                assert {ranges.of(key, path, d) for d in range(9)} <= set(ranges.met_by(rule_key, rule_path))


# Repair of conversations


def cheapest(rows):
    """Least (cost, audit) by search over all edits with a table of suffixes; rows are (initial, must go, cut)."""
    from functools import cache

    @cache
    def rest(i, state):  # state: 0 nothing yet, 1 after s, 2 expects a, 3 expects u after an a
        out = [(0, "")] if i == len(rows) and state in (0, 3) else []
        steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        put = lambda cost, letter, tail: out.append((cost + tail[0], letter + tail[1]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            put(3, "D", rest(i + 1, state))
            if not gone:
                for letter, then in steps.items():
                    if letter == initial:
                        put(cut, "K", rest(i + 1, then))
                    elif letter in "ua":
                        put(2 + cut, "R", rest(i + 1, then))
        # At most three inserts in a row help: more would come back to the same state.
        for letters in ("u", "ua", "a", "au", "uau", "aua"):
            now, ok = state, True
            for letter in letters:
                ok = ok and letter in {0: "u", 1: "u", 2: "a", 3: "u"}[now]
                now = {"u": 2, "a": 3}[letter]
            if ok:
                tails = tail_without_insert(i, now)
                if tails:
                    out.append((2 * len(letters) + tails[0], "I" * len(letters) + tails[1]))
        return min(out)

    @cache
    def tail_without_insert(i, state):
        out = [(0, "")] if i == len(rows) and state in (0, 3) else []
        steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        if i < len(rows):
            initial, gone, cut = rows[i]
            tail = rest(i + 1, state)
            out.append((3 + tail[0], "D" + tail[1]))
            if not gone:
                for letter, then in steps.items():
                    tail = rest(i + 1, then)
                    if letter == initial:
                        out.append((cut + tail[0], "K" + tail[1]))
                    elif letter in "ua":
                        out.append((2 + cut + tail[0], "R" + tail[1]))
        return min(out, default=None)

    return rest(0, 0)


def test_alignment_against_search():
    rng = random.Random(11)
    for n in [*range(0, 6)] * 80 + [9, 14, 30, 60] * 12:
        weights = rng.choice([(1, 4, 4, 1), (1, 1, 0, 0), (3, 1, 1, 1), (0, 5, 5, 0)])
        rows = tuple((rng.choices("suat", weights)[0], rng.random() < 0.15, rng.random() < 0.2) for _ in range(n))
        rows = tuple((i, g, c and not g) for i, g, c in rows)
        codes = Codes([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        assert align(codes) == cheapest(rows), rows


def test_alignment_of_a_long_conversation():
    initials = list("ua" * 2000)
    del initials[1001], initials[2003]
    initials[3000:3000] = ["u", "t"]
    n = len(initials)
    cost, audit = align(Codes(initials, [False] * n, [False] * n))
    assert 0 < cost <= 10 and len(audit) - audit.count("I") == n


BLANK = " \t\n\v\f\r"


def repaired(rows):
    """The contract's row of one conversation from (turn, role, text), without the id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        stripped = text.strip(BLANK)
        fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        codes.append((role[:1], fault in (0, 1), fault == 2))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
    cost, audit = cheapest(tuple(codes))
    out, left, at = [], len(audit) - audit.count("D"), 0
    for step in audit:
        name = "user" if left % 2 == 0 else "assistant"
        if step == "I":
            out.append(f"{name}:")
        else:
            if step != "D":
                out.append(f"{rows[at][1] if step == 'K' else name}:{rows[at][2]}")
            at += 1
        left -= step != "D"
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def test_repair_of_given_conversations(spark, larger):
    rows = [tuple(r) for r in spark.read.parquet(f"{larger}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: repaired(own) for conv, own in damaged(rows).items()}
    got = queries.op12_repair(spark, larger).select(*COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    # All kinds of edits and faults occur.
    assert set("".join(w[6] for w in want.values())) == set("KRDI") and all(any(w[k] for w in want.values()) for k in range(6))


def test_repair_of_awkward_rows(spark, tmp_path):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "sys"], ["hello.", "what?", "cut off", "", " \t", None, "x" * 300_000, "ok!  ", "\u00a0", "zwölf。"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(-3, 40)] for _ in range(rng.randrange(1, 12))]
    rows += rows[:25]
    spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, present boolean").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_repair(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {conv: repaired(own) for conv, own in damaged(rows).items()}
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair_conversations(empty).collect() == []
    gone = spark.createDataFrame([(1, 2, "user", "x", False), (2, 1, "user", "x.", None)], "conv_id bigint, turn bigint, role string, text string, here boolean")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r[1:]) for r in repair_conversations(gone, present_col="here").select(*COLUMNS).collect()} == {1: nothing, 2: nothing}


# Whitening


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def check_whitening(rows, got, components=8):
    """Against numpy's own eigenvectors of the covariance."""
    kept = usable(rows)
    x = np.floor(np.array([v for _, v in kept], float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    assert len(got) == n * k
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r
    assert {i for i, _ in kept} == set(by_id)
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    mine = np.array([[by_id[i][c + 1]["whitened"] for c in range(k)] for i, _ in kept])
    sign = np.sign((want * mine).sum(axis=0))
    assert np.abs(want * sign - mine).max() < 1e-8
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert [by_id[i][1]["deviation"] for i, _ in kept] == deviations and {r["n"] for r in got} == {n}
    explained = np.array([by_id[kept[0][0]][c + 1]["explained"] for c in range(k)])
    assert np.abs(explained / (values[:k] / values.sum()) - 1).max() < 1e-10
    error = np.abs(mine.T @ mine / n - np.eye(k)).max()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] <= 1e-10 and error <= 1e-10


def test_whitening_of_given_embeddings(spark, larger):
    rows = [tuple(r) for r in spark.read.parquet(f"{larger}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, queries.op11_whitening(spark, larger).collect())


SCHEMA = "vec_id bigint, embedding array<double>, n string, x string, component string"


def vectors_frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)


@pytest.mark.parametrize("d", [3, 8, 40, 150])
def test_whitening_with_awkward_rows(spark, d):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((300, d)) @ np.diag(np.linspace(3, 0.5, d))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(m)]
    bad = [None, [None] * d, [*([1.0] * (d - 1)), None], [*([1.0] * (d - 1)), float("nan")], [float("-inf"), *([1.0] * (d - 1))]]
    bad = [(1000 + k, v) for k, v in enumerate(bad)]
    frame = vectors_frame(spark, rows + bad + [(2000, [1.0] * (d + 1)), (2001, [])])
    check_whitening(rows + bad, whitening.whiten(frame).collect())


def test_whitening_of_close_and_tied_variances(spark):
    rng = np.random.default_rng(1)
    flat = rng.standard_normal((2000, 60))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(flat)]
    check_whitening(rows, whitening.whiten(vectors_frame(spark, rows)).collect())
    # Points of a cross: all variances are equal, any basis of the space is right.
    cross = [(k, [float((1 if k < 12 else -1) * (j == k % 12)) for j in range(12)]) for k in range(24)]
    got = whitening.whiten(vectors_frame(spark, cross)).collect()
    w = np.zeros((24, 8))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / 24 - np.eye(8)).max() < 1e-9


def test_whitening_without_variance_or_rank(spark):
    assert whitening.whiten(vectors_frame(spark, [])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, [])] * 2)).collect() == []
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(50)]
    got = whitening.whiten(vectors_frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    large = whitening.whiten(vectors_frame(spark, [(k, [float(k) * 1e6, 1.0]) for k in range(4)] + [(9, [2.0**30, 1.0])])).collect()
    sums = 3 * 4 * 1_024_000_000 // 2
    assert {r["vec_id"]: r["deviation"] for r in large} == {k: (d if (d := (4 * 1_024_000_000 * k - sums) ** 2) < 2**63 else None) for k in range(4)}


def test_whitening_keeps_rows_of_one_id(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((40, 5))
    rows = [(None if k % 2 else 7, [float(c) for c in v]) for k, v in enumerate(m)]
    got = whitening.whiten(vectors_frame(spark, rows)).collect()
    assert len(got) == 200 and {r["vec_id"] for r in got} == {None, 7}


# Very long runs in packing


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\r\n" * 400_000, "x" + " " * 1_000_000 + "y", "a" * 2_000_000, "7" * 500_000], ids=["blanks", "lines", "returns", "inside", "letters", "digits"])
def test_ids_of_very_long_runs(text):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode(text).tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_packing_of_very_long_runs(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "short"), (3, "\t" * 1_200_000)], "doc_id bigint, text string")
    rows = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by_doc = {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in (1, 2, 3)}
    assert all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in rows) and set(by_doc) == {1, 2, 3} and by_doc[1] > 1000


# Broken pages and what must not leak into a main text


BROKEN = {
    "ends of nothing": "<b>" * 20_000 + "</i>" * 20_000, "tags without end": "<a " * 100_000, "ends without end": "</a " * 100_000, "quotes": '<a x="' * 100_000 + ">", "open comments": "<!--" * 100_000 + ">",
    "declarations": "<?" * 100_000, "deep headings": "<b>" * 20_000 + "<h1></h1>" * 20_000, "deep foreign": "<svg>" + "<g>" * 20_000 + "<path/>" * 20_000, "far paragraph": "<p><table>" + "<b>" * 20_000 + "<h1></h1>" * 20_000,
    "items": "<ul>" + "<li><b>" * 20_000, "less than": "< " * 200_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    def took(page):
        began = time.process_time()
        Dom(page)
        return time.process_time() - began

    page = BROKEN[name]
    # A quadratic reading of the longest of these takes minutes.
    assert took(page) < 12


def test_unclosed_parts_are_left_out_as_in_browsers():
    model = train()
    article = "<article><h1>High water</h1><p>Rain fell on the hills for nine days, and the river rose until it reached the mill.</p></article>"
    want = "High water Rain fell on the hills for nine days, and the river rose until it reached the mill."
    for broken in ("<!-- never closed <p>Rain fell on the village as well.</p>", '<p class="x', "</div", "<select><option>Monday</option><option>Tuesday</option></select>"):
        assert main_text(article + broken, model) == want, broken
    assert main_text("<p>a < b and c > d</p>" + article, model).endswith(want)


@pytest.mark.parametrize(
    "box",
    [
        '<div class="gdpr-modal"><p>We use cookies and similar techniques to measure how this site is read.</p><button>Agree</button></div>',
        '<div class="responses"><p>I lived there as a child and remember the river well, it was never that high.</p><p>Thank you!</p></div>',
        '<ol class="commentlist"><li><p>I lived there as a child and remember the river well, it was never that high.</p></li><li><p>Same here.</p></li></ol>',
    ],
    ids=["consent", "responses", "commentlist"],
)
def test_boxes_do_not_leak(box):
    text = "Rain fell on the hills for nine days, and the river rose until it reached the mill. Nobody had seen such water before."
    for page in (f"<body><article><h1>High water</h1><p>{text}</p><p>{text}</p></article>{box}</body>", f'<body>{box}<div class="post"><h1>High water</h1><p>{text}</p><p>{text}</p></div></body>'):
        assert main_text(page, train()) == f"High water {text} {text}"
