"""Centroid clustering, spelling variants and personal data, against plain versions."""


import base64
import hashlib
import random
import time

import numpy as np
import pytest

from pairwright.llm import centroids, counts, pages, personal, toxicity, variants
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>"


def some_vectors(seed=3, n=700, groups=9):
    rng = np.random.default_rng(seed)
    heads = rng.normal(0, 2, (groups, 64))
    out = [(i, (heads[rng.integers(groups)] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for i in range(n)]
    out += [(1000 + i, out[0][1]) for i in range(300)]  # copies
    out += [(i, rng.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(2000, 2100)]
    return out


@pytest.mark.parametrize(("block", "far"), [(64, 0.0), (4096, 0.0), (256, 3e6)])
def test_lloyd_matches_plain_version(spark, block, far):
    rows = some_vectors() + [(None, [0.25] * 64), (None, [0.25] * 64), (5000, [far + 0.5] * 64), (5001, [float(-far)] + [0.0] * 63)]
    odd = [(6000, None), (6001, []), (6002, [1.0] * 63), (6003, [1.0] * 63 + [None]), (6004, [1.0] * 63 + [float("nan")]), (6005, [float("inf")] + [1.0] * 63)]
    docs = spark.createDataFrame(rows + odd, VECTORS).repartition(3)
    got = sorted(map(tuple, centroids.cluster(docs, block=block).collect()), key=str)
    assert got == sorted(brute.lloyd(rows), key=str) and len(got) == len(rows)


def test_lloyd_small_tables(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    three = [(1, [0.5] * 64), (2, [0.5] * 64), (2, [1.0] * 64)]
    got = centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in three], VECTORS + ", cluster string, distance int"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute.lloyd(three))


def test_walks_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    heads = rng.integers(-300, 300, (16, 64))
    points = (heads[rng.integers(16, size=3000)] + rng.integers(-9, 9, (3000, 64))).astype(np.int64)
    tree, order = centroids.cover_tree(points)
    assert sorted(order) == list(range(3000)) and (tree.points == points[order]).all()
    for lo, hi, first, last, r in zip(tree.lo, tree.hi, tree.first, tree.last, tree.radius):
        assert np.sqrt(((tree.points[lo:hi] - tree.points[lo]) ** 2).sum(1)).max() <= r + 1e-9
        assert first == last or ([int(tree.lo[first]), int(tree.hi[last - 1])] == [lo, hi] and last - first > 1)
    over = centroids.cover_tree(heads, 1, 16)
    parts = list(centroids.assign(tree, heads, over))
    want = ((points[order][:, None] - heads) ** 2).sum(2).argmin(1)
    for lo, hi, cluster, _ in parts:
        assert (want[lo:hi] == cluster).all()
    assert sum(hi - lo for lo, hi, _, gaps in parts if gaps is None) > 2900 and sum(hi - lo for lo, hi, _, _ in parts) == 3000


DOCS = "doc_id long, text string"


@pytest.mark.parametrize("letters", ["abÀÿ", "ab"])
def test_variants_match_plain_version(spark, letters):
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 150])]) for _ in range(40))) for i in range(60)]
    rows += [(None, "Straße STRASSE straßen, strasse-straßen"), (None, "strasse×y strasse×y strasse×y"), (7, None), (8, ""), (9, "aaaaa aaaaaa aaaaaaa " * 5)]
    rows += [(100, "aéb\U0001f600aéb")] * 3 + [(i, "tete letter lettre setter better " * 5) for i in range(200, 210)] + [(300, "chained " * 4 + "chaine " * 9 + "chain " * 30)]
    got = variants.group(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    want = sorted(brute.variants(rows))
    assert sorted(map(tuple, got)) == want and len(want) > 50 and any(r[1] for r in want)


def test_variants_of_very_long_words_and_empty_tables(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    one, two = long[:777] + "é" + long[778:], long[:150_000] + long[150_001:]
    rows = [(1, " ".join([long] * 9)), (2, " ".join([one] * 4)), (3, " ".join([two] * 3)), (4, long[::-1])]
    got = {r.word: r for r in variants.group(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", word int")).collect()}
    assert {w: (r.n, r.n_near, r.form == long) for w, r in got.items()} == {long: (9, 2, False), one: (4, 1, True), two: (3, 1, True)}
    assert variants.group(spark.createDataFrame([], DOCS)).count() == 0


def test_followed_forms(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 0) for i in range(9)]
    got = variants.followed(spark.createDataFrame(chain, "id long, up long")).collect()
    assert {(r.id, r.up) for r in got} == {(i, 40) for i in [*range(40), *range(100, 109)]}


def test_rules_match_the_plain_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for letters in ("a1.@-_ ", "12. ", "0123456789 -", "+12() .-", "a.@", "é@a.b1+ ") for _ in range(1500)]
    texts += ["4111 1111-1111 1111, +44 20 7946 0958 x@y.z@q.r 001.02.3.255.9.9.9.9 256.1.1.1.1", "a@b.c_d@e.f"]
    for t in texts:
        assert [(personal.KINDS[k], s, e) for k, s, e in personal.base(t)] == brute.personal(t), t


@pytest.mark.parametrize("part", ["a", "1", "@", "a@", "1.", "+1", "+1 ", "a1 ", "1 ", ".", "(", "+1-"])
def test_rules_and_graphs_are_linear(part):
    began = time.perf_counter()
    text = part * (1_000_000 // len(part))
    personal.base(text), personal.nodes(text)
    assert time.perf_counter() - began < 8


def test_messages_are_exact_on_trees_and_close_on_circles():
    rng = np.random.default_rng(3)
    tree = np.array([(0, 1), (1, 2), (1, 3), (4, 3), (5, 0)])
    for ends, close in ((tree, 1e-4), (np.vstack([tree, [(2, 5)]]), 0.1)):
        unary, pots = rng.normal(0, 1, (6, 3)), rng.normal(0, 0.6, (len(ends), 3, 3))
        assert np.abs(personal.marginals(unary, ends, pots) - np.array(brute.enumerated(unary.tolist(), ends.tolist(), pots.tolist()))).max() < close
    assert personal.marginals(np.zeros((2, 3)), np.zeros((0, 2), int), np.zeros((0, 3, 3))).tolist() == [[1 / 3] * 3] * 2


def known_texts():
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice("the of and an in to is that".split()) for _ in range(rng.randint(2, 9)))
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    address = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    name = lambda: f"{rng.choice('abcdefg')}{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
    other = lambda: rng.choice([f"v{rng.randint(1, 9)}", f"chapter {rng.randint(1, 99)}", f"{rng.randint(1900, 2030)}", f"key{rng.randint(10**8, 10**9)}x"])
    return [(i, f"{say()} {rng.choice([number, address, name, other, other])()} {say()} {other()} {say()}") for i in range(600)]


def test_personal_data_found_by_links(spark):
    told = known_texts()
    asked = [
        (9001, "my number is +1 (743) 555-3824 ok, later call 743-555-3824 or (743) 555-3824 again"),
        (9002, "in 1987 chapter 12 of version 3.2 had 743 pages"),
        (9003, "mail bob@mail3.example.com and 10.20.30.40 then"),
        (9004, "no data here"), (9005, None), (9006, ""), (None, "x " * 5000 + "1.2.3.4"), (None, "x " * 5000 + "1.2.3.4"),
    ]
    docs = spark.createDataFrame(told, DOCS)
    model = personal.train(docs)
    got = personal.scan(spark.createDataFrame([(*r, 1) for r in asked], DOCS + ", n_ip int"), model).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    by = {r.doc_id: r for r in got}
    text = asked[0][1]
    found = [text[int(s) : int(e)] for _, s, e in (x.split(":") for x in by[9001].spans.split(","))]
    assert found == ["+1 (743) 555-3824", "743-555-3824", "(743) 555-3824"] and by[9001].n_phone == 1
    assert [by[d].spans for d in (9002, 9004, 9005, 9006)] == [""] * 4 and by[9003].n_email == by[9003].n_ip == 1
    assert sum(r.doc_id is None and r.n_ip == 1 and r.spans == "ip:10000:10007" for r in got) == 2
    for r, (_, t) in zip(personal.scan(docs, model).collect(), told):
        spans = brute.personal(t)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said  # nothing else is personal
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k in personal.KINDS]


def test_personal_data_without_any(spark):
    assert personal.scan(spark.createDataFrame([], DOCS), personal.train(spark.createDataFrame([], DOCS))).count() == 0
    plain = spark.createDataFrame([(1, "page 3"), (2, "x")], DOCS)
    assert [r.spans for r in personal.scan(plain, personal.train(plain)).collect()] == ["", ""]


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    with open(counts.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_blanks_count_as_the_plain_encoder_counts_them(bpe):
    rng = random.Random(6)
    parts = ["a b", " ", "\n" * 1500, " " * 1000, " " * 1001, "\t \u3000\xa0" * 400, "\u2028" * 1200, "word", "\x1c" * 1100, "\u200b" * 1100, "é", "it's", "12"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        assert counts.n_tokens(bpe, text) == len(bpe.encode_ordinary(text))


@pytest.mark.parametrize("text", [" " * 10**7, "x" + "\n" * 10**7 + "y", "a" * 10**7])
def test_very_long_runs_are_counted(bpe, text):
    assert counts.n_tokens(bpe, text) > 10**6


def test_a_batch_with_a_very_long_run_commits(spark, tmp_path):
    rows = [(1, "one two", "s", "en", "insert", 1), (2, "a" + " " * 1_000_000 + "b", "s", "en", "insert", 1)]
    changes = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, op string, ord long")
    rollup = counts.TokenRollup(spark, str(tmp_path / "roll"))
    rollup.commit(changes, 1)
    assert {r.version: (r.docs, r.tokens) for r in rollup.totals().collect()}[counts.WORDS_VERSION] == (2, 4)


LONG = "<p>" + "A long paragraph, with commas, of some words. " * 8 + "</p>"
ONCE = " ".join(("A long paragraph, with commas, of some words. " * 8).split())


def test_comments_sidebars_and_adverts_go_at_any_length():
    for page, want in {
        f"<article>{LONG}<div class='comments'>{'<div class=comment><p>I, as a reader, say this at some length here.</p></div>' * 12}</div></article>": ONCE,
        f"<article>{LONG}<section id='comments'>{LONG * 3}</section></article>": ONCE,
        f"<article>{LONG}<div class=sidebar>{LONG * 2}</div></article>": ONCE,
        f"<div>{LONG * 2}<div class=advert>{LONG * 2}</div></div>": f"{ONCE}\n{ONCE}",
        f"<div class=reply>{LONG * 9}</div><div><h1>Forum</h1></div>": "\n".join([ONCE] * 9 + ["Forum"]),
    }.items():
        assert pages.extract(page) == want


def test_what_stands_beside_ancestors_is_kept():
    assert pages.extract(f"<div><div><h1>TITLE</h1><p>INTRO one, two</p></div>\n<div>and<div>{LONG * 3}</div></div></div>") == "\n".join(["TITLE", "INTRO one, two", "and"] + [ONCE] * 3)
    assert pages.extract(f"<main><article>{LONG}</article><article>{LONG}</article></main>") == f"{ONCE}\n{ONCE}"
    assert pages.extract(f"<main><article>{LONG}</article><article><a href=x>more of it here</a></article></main>") == ONCE


@pytest.mark.parametrize(
    ("head", "part", "tail"),
    [
        ("", "<a", ""), ("", "if (i<n) x; ", ""), ("", '<a ">"', '"'), ("", "<div>a", ""), ("", "<i>", "<hr>" * 100_000), ("", "<p>", "</span>" * 100_000), ("<script>", "</script ", ""),
        ("", "<div>", "<div class=ad>x</div>" * 50_000), ("", "&", ""), ("", "<!--", ""), ("<b><div>", "<i>x", "</b>" * 200_000), ("", "<a b='", ""), ("", "<table><tr><td>", ""),
    ],
)
def test_pages_are_read_in_linear_time(head, part, tail):
    page = head + part * (1_000_000 // len(part)) + tail
    began = time.perf_counter()
    pages.extract(page)
    assert time.perf_counter() - began < 25


def test_huge_pages():
    began = time.perf_counter()
    assert pages.extract("<a" * 500_000) == "<a" * 500_000
    assert len(pages.extract("i<n " * 2_500_000)) == 10**7 - 1
    assert time.perf_counter() - began < 15
    assert pages.extract("<p>a<b and c</p><p title=\"x>y>b</p><p>1 < 2 <3</p>").startswith("a")


def test_toxicity_training_matches_a_plain_trainer():
    rng = np.random.default_rng(9)
    bags = [np.unique(rng.integers(0, 60, rng.integers(1, 25))) for _ in range(70)] + [np.zeros(0, int)] * 2
    labels = [int(bag[:1].sum() % 3 == 0) for bag in bags]
    for steps in (2, 12):
        weight, bias = toxicity.train(bags, labels, 0.5, bits=6, dim=3, steps=steps)
        plain, plain_bias = brute.toxicity([b.tolist() for b in bags], labels, steps, 64, 3)
        assert abs(bias - plain_bias) < 1e-3 and set(np.flatnonzero(weight)) == set(plain)
        assert max(abs(weight[b] - w) for b, w in plain.items()) < 0.02 * max(map(abs, plain.values()))


def test_toxicity_bags_survive_packing():
    for bag in ([], [0], [63], [1, 5, 62], range(64)):
        assert toxicity.unpack(toxicity.pack(np.array(bag, int), 6), 6).tolist() == list(bag)
