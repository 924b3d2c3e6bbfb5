"""The operators with Python in their tasks, against plain versions."""

import base64
import hashlib
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.llm import components, counts, decontaminate, jaccard, licenses, pages, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string"


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def near_copies(seed, groups=8, size=6, n=60):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(n + 7 * g)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 99)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [3, 256])
def test_jaccard_matches_plain_version(spark, block):
    rows = near_copies(5) + [(100, None), (101, ""), (102, "a b"), (103, "A  B"), (104, "x y z q r s"), (105, " \n")]
    rows += [(110 + i, rows[0][1].upper()) for i in range(9)]  # copies
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, DOCS), block=block).collect()}
    root, links = brute.jaccard(rows)
    assert got == {d: (rows[root[i]][0], links[i]) for i, (d, _) in enumerate(rows)}
    assert max(links) > 9


def test_jaccard_keep_one_and_defined_cases(spark):
    t = "one two three four five six seven eight"
    rows = [(1, t, 0), (1, t, 1), (2, t + " nine", 0), (None, t, 0), (3, None, 0), (3, None, 0), (4, "other words that are not the same", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 3), (False, 4), (True, 0)]
    joined = jaccard.join(docs).collect()
    assert len(joined) == 7 and {r.n_links for r in joined if r.doc_id == 1} == {3}
    assert [r.class_id for r in joined if r.doc_id in (1, 2)] == [None] * 3  # the first has no id
    assert jaccard.join(empty(spark)).count() == 0
    assert jaccard.shortened(0.8, 24, 8, 0.9995) == 5 and jaccard.shortened(0.9, 24, 8, 0.9995) == 8


@pytest.mark.parametrize(("edits", "depth"), [((1, 2), 8), ((3, 5), 6)])
def test_jaccard_prefix_follows_the_data(spark, edits, depth):
    """Close copies are found at whole labels; where less similar pairs occur, the prefix gets shorter."""
    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(260)]
        for c in range(4):
            text = list(base)
            for at in range(rng.randint(*edits) if c else 0):
                text[20 + 50 * at] = f"new{c}{at}"
            rows.append((len(rows), " ".join(text)))
    got = jaccard.classes(spark.createDataFrame(rows, DOCS))
    _, links = brute.jaccard(rows)
    assert got.depth == depth and got.pairs == sum(links) // 2 and got.recall >= 0.9995
    assert {r.k1: r.links for r in got.found.collect()} == dict(enumerate(links))


def test_jaccard_measured_recall(spark):
    """With few short trees pairs are missed; the measured recall says so, and is near that against brute force."""
    rows = near_copies(11, groups=60, size=5, n=70)
    got = jaccard.classes(spark.createDataFrame(rows, DOCS), trees=2, depth=6, target=0.2)
    pairs = sum(brute.jaccard(rows)[1]) / 2
    copies = sum(r.size * (r.size - 1) / 2 for r in got.found.collect())
    assert 0.3 < got.recall < 0.98 and abs(got.pairs / (pairs - copies) - got.recall) < 0.15


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_decontamination_matches_plain_version(spark):
    rng = random.Random(2)
    vocab = ["ab", "Cd", "é", "x1", "the", "of", "zz"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 14, 40]))) for i in range(3, 25)] + [(90, None), (91, "--"), (92, "The of")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "pre " + items[5][1] + " post"), (52, "the OF"), (None, items[6][1])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        n, hit, who = brute.contamination(t, items)
        want.append((d is None, d or 0, n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), hit > 0))
    for chars in (10**6, 60):  # one pattern group, and several
        got = decontaminate.report(docs, bench, group_chars=chars).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
        left = decontaminate.clean(docs, bench, group_chars=chars)
        assert left.columns == docs.columns and left.count() == sum(not w[-1] for w in want)
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).filter("contaminated").count()


def test_long_windows_are_found_at_every_offset(spark):
    item = [f"i{k}" for k in range(25)]
    rows = [(k, " ".join(["pad"] * k + item[k : k + 10] + ["pad"] * 3)) for k in range(16)] + [(99, " ".join(item[:9]))]
    got = decontaminate.report(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert all((r.n_hit == 10) == (r.doc_id != 99) and (r.n_hit == 0) == (r.doc_id == 99) for r in got)


def test_toxicity_held_out_and_misspellings(spark):
    rng = random.Random(4)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "no", "se"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(700):
        ws = [word() for _ in range(rng.randint(10, 60))]
        if bad := rng.random() < 0.4:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["wretchgit", "foulgrub"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    typos = [(1000, "ba ke wretchgitt lo mi"), (1001, "mi ra fooulgrub ke"), (1002, None), (1003, ""), (None, "ba ke lo")]
    docs, lab = spark.createDataFrame(rows + typos, DOCS), spark.createDataFrame([*labels, labels[0], (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values() if r.doc_id is not None and r.doc_id < 1000) == len(held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[1000].predicted == got[1001].predicted == 1 and not got[None].held_out
    assert got[1002].score == got[1003].score and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.score(docs, toxicity.fit(docs, lab.limit(0))).first()
    assert none.score == 0.5
    assert toxicity.score(empty(spark), toxicity.fit(docs, lab.filter("toxic = 1"))).count() == 0


RANKS = counts.RANKS if os.path.exists(counts.RANKS) else None


def test_token_rollup_batches(spark, tmp_path):
    schema = "op string, doc_id long, text string, source string, lang string, ord int"
    roll = counts.TokenRollup(spark, str(tmp_path / "roll"), RANKS)
    held = {}

    def apply(batch, rows, times=1):
        for op, d, t, s, lang, _ in sorted(rows, key=lambda r: r[5]):
            held[(d, t if d is None else None)] = None if op == "delete" else (t, s, lang)
        for _ in range(times):
            roll.commit(spark.createDataFrame(rows, schema), batch)

    def totals():
        want = {}
        for x in held.values():
            if x:
                t, s, lang = x
                for v, n in versions(t):
                    a, b = want.get((s, lang, v), (0, 0))
                    want[(s, lang, v)] = (a + 1, b + n)
        return want

    def versions(t):
        out = [(counts.WORDS_VERSION, len(brute.words(t)))]
        if RANKS:
            import tiktoken

            with open(RANKS, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            out.append((counts.BPE_VERSION, len(tiktoken.Encoding("t", pat_str=counts.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary(t or ""))))
        return out

    got = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in roll.totals().collect()}
    apply(1, [("insert", 1, "a b c", "s", "en", 0), ("insert", 2, "dé e", "s", "fr", 0), ("insert", 3, None, None, None, 0), ("insert", None, "no id here", "s", "en", 0)])
    assert got() == totals()
    second = [("revise", 1, "a b c d e f", "t", "en", 0), ("delete", 2, None, None, None, 0), ("delete", 77, None, None, None, 0), ("insert", 4, "old", "s", "en", 0), ("insert", 4, "newer text", "s", "en", 1)]
    apply(2, second, times=2)  # committed twice
    assert got() == totals()
    apply(3, [("insert", 1, "back", "s", "en", 0), ("insert", 2, "again", "s", "fr", 0)])
    assert not roll.commit(spark.createDataFrame(second, schema), 2)  # a late repeat of an older batch
    assert got() == totals()
    roll.commit(empty(spark, schema), 5)
    assert got() == totals()
    with pytest.raises(ValueError, match="batch 4 comes after batch 5"):
        roll.commit(spark.createDataFrame(second, schema), 4)
    roll.compact()
    assert got() == totals()
    apply(6, [("delete", 1, None, None, None, 0), ("revise", 4, "newer text again", "s", "en", 0)])
    assert got() == totals()


def test_token_rollup_counts_committed_batches_only(spark, tmp_path, monkeypatch):
    schema = "op string, doc_id long, text string, source string, lang string"
    rows = lambda op, t: spark.createDataFrame([(op, 1, t, "s", "en")], schema)
    roll = counts.TokenRollup(spark, str(tmp_path / "roll"), None, compact_after=2)
    total = lambda: [(r.docs, r.tokens) for r in roll.totals().collect()]
    roll.commit(rows("insert", "a b"), 1)
    write = roll._write

    def dies(df, name):
        if name == "deltas":
            raise OSError("lost")
        return write(df, name)

    monkeypatch.setattr(roll, "_write", dies)
    with pytest.raises(OSError, match="lost"):
        roll.commit(rows("revise", "a b c d e f g"), 2)
    monkeypatch.setattr(roll, "_write", write)
    assert total() == [(1, 2)]
    roll.commit(rows("revise", "a b c"), 3)
    assert total() == [(1, 3)]
    roll.commit(rows("revise", "a"), 4)  # more folders than compact_after: rewritten as one each
    assert total() == [(1, 1)] and len(roll._now()[1]["state"]) == 1
    roll.commit(rows("delete", None), 5)
    assert total() == []


def test_token_count_query_is_the_table(spark):
    import tiktoken

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    with open(counts.RANKS, "rb") as f:
        bpe = tiktoken.Encoding("t", pat_str=counts.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = {}
    for r in rows:
        for v, n in ((counts.WORDS_VERSION, len(brute.words(r.text))), (counts.BPE_VERSION, len(bpe.encode_ordinary(r.text or "")))):
            a, b = want.get((r.source, r.lang, v), (0, 0))
            want[r.source, r.lang, v] = a + 1, b + n
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in counts.query(spark, sf).collect()} == want




PAGES = {
    "<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div id=main><h2>Head</h2>"
    "<p>First, a paragraph with some words, long enough to count as text.</p><p>Second one &amp; caf&eacute;<br>next\n line.</p></div>"
    "<div class='sidebar'><p>Buy, now, this, is, a, side, bar, with, many, commas.</p></div><div id='comments'><p>I, as, a, reader, disagree.</p></div>"
    "<form><p>Name</p></form><footer>(c)</footer>": "Head\nFirst, a paragraph with some words, long enough to count as text.\nSecond one & café next line.",
    "<body><main><article><h1>A</h1><section><p>One.</p></section><aside>No</aside><section><ul><li>x<li>y</ul></section><div class=share-bar>s</div></article></main></body>": "A\nOne.\nx\ny",
    "": "",
    "<script>x</script><style>p{}</style>": "",
    "just &lt;text&gt; &am": "just <text> &am",
    "<table><tr><td>a, b</td><td>c</table>": "a, b\nc",
    "<p>un<b>closed <i>it<p>next <!-- no --> one": "unclosed it\nnext one",
    "<div class=pageHeader>Site</div><article><div class='post-header'><h1>T</h1></div><p>x</p><div class=adSlot>y</div><footer>z</footer></article>": "T\nx",
    "<article><p hidden>h</p><p style='display: none'>s</p><p title='a > b'>seen</p></article>": "seen",
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
}


def test_pages(spark):
    rows = [(i, None, h) for i, h in enumerate(PAGES)] + [(99, "u", None)]
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[99].text == "" and got[99].url == "u"
    assert pages.extract_pages(empty(spark, "page_id long, url string, html string")).count() == 0


def test_licenses_match_plain_version(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/x.py", "code here"),
        ("a/b/y.py", "This work is licensed under the GNU General Public License, version 3.\nmore"),
        ("a/b/COPYING", "some words first\nReleased under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("z/LICENSE.txt", "All rights reserved."),
        ("z/LICENCE", "Licensed under the Apache License, Version 2.0"),
        ("z/w", None),
        ("top.txt", ""),
        (None, "All rights reserved."),
        ("q/deep/file", "the license of this version is under the public work"),
    ]
    files = spark.createDataFrame([(*r, 1, "n") for r in rows], "path string, text string, license int, name string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    df = {t: sum(t in licenses.terms(x or "") for _, x in rows) for y in licenses.TEMPLATES.values() for t in licenses.terms(y)}
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
    for p, text in rows:
        best = max(((round(brute.cosine(line, tpl, idf, math.log(1 + len(rows)) + 1), 6), name) for line in (text or "").split("\n") for name, tpl in licenses.TEMPLATES.items()), key=lambda x: x[0])
        assert (got[p].own_license is not None) == (best[0] >= licenses.MIN_COSINE)
        if got[p].own_license:
            assert abs(got[p].own_score - best[0]) < 1e-5
    assert (got["a/b/c/x.py"].license, got["a/b/c/x.py"].from_dir) == ("MIT", "a/b")
    assert got["a/b/y.py"].license == "GPL-3.0" and got["a/b/y.py"].from_dir is None
    assert got["z/w"].from_dir == "z" and got["top.txt"].license is None and got[None].license == "Proprietary"
    assert all(r.name == "n" for r in got.values())
    assert licenses.scan(empty(spark, "path string, text string")).count() == 0


#: Every license line that occurs in the documents, and other notices that stand alone.
LICENSE_LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "MIT License": "MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "SPDX-License-Identifier: ISC": None,
}


def test_every_notice_alone(spark):
    rows = [(f"{i}/x", line) for i, line in enumerate(LICENSE_LINES)] + [(f"pad/{i}", "plain words") for i in range(300)]
    got = {r.path: r for r in licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"{i}/x"].own_license for i in range(len(LICENSE_LINES))] == list(LICENSE_LINES.values())
    assert all(got[f"{i}/x"].own_score > 0.99 for i, name in enumerate(LICENSE_LINES.values()) if name)


SURROUNDED = {
    "// Licensed under the Apache License, Version 2.0, see LICENSE file.": "Apache-2.0",
    "Copyright (c) 2024 Example Inc. All rights reserved.": "Proprietary",
    "# This file, as all the others beside it, is\n# licensed under the Apache\n# License, Version 2.0, and comes with nothing else": "Apache-2.0",
    "some prose " * 400 + "Released under the MIT License. " + "and more " * 400: "MIT",
    " * it under the terms of the GNU Lesser General Public License as published\n * by the Free Software Foundation, either version 3 of the License, or": "LGPL-3.0",
    "all the rights of the others and of every other reserved person": None,
    "GNU Lesser General Public License, version 2.1, wrapped among quite a few other words of a text": None,
}


def test_notices_among_other_words_at_two_sizes(spark):
    seen = []
    for copies in (3, 60):
        rows = [(f"{c}/{i}", line) for c in range(copies) for i, line in enumerate(SURROUNDED)] + [(f"pad/{i}", "plain words here") for i in range(50 * copies)]
        got = licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).filter("path NOT LIKE 'pad/%'").collect()
        for r in got:
            assert r.own_license == list(SURROUNDED.values())[int(r.path.split("/")[1])]
        seen.append({r.path: r.own_score for r in got if r.path.startswith("0/")})
    assert seen[0].keys() == seen[1].keys() and all((a is None and seen[1][p] is None) or abs(a - seen[1][p]) < 0.02 for p, a in seen[0].items())
    header = "some words // Licensed under Apache License of version 2.0 and more words"
    small, large = (licenses.Matcher(n, {t: n // 100 for _, x in licenses.templates() for t in licenses.terms(x)}).scan(header) for n in (1000, 6_000_000))
    assert small == large and small[0] > licenses.MIN_COSINE


def test_whole_license_texts_are_told_apart(spark):
    files = {}
    for name, (text, _) in licenses.FULL_TEXTS.items():
        text = "Copyright (c) 2021 Jane Doe and others. " + text.replace("copyright holder", "regents of some place").replace("organization", "Regents")
        files[name] = "\n".join(f" * {line}" for line in textwrap.wrap(text, 70)) + "\nint main() { return 0; }"
    half = licenses.FULL_TEXTS["Zlib"][0][:150]
    rows = [(name, text) for name, text in files.items()] + [("half", half), ("long", "plain words " * 20000 + files["BSD-2-Clause"])] + [(f"pad/{i}", "plain words of the text") for i in range(300)]
    got = {r.path: r for r in licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[name].own_license for name in files] == list(files) and all(got[name].own_score >= licenses.FULL_COSINE for name in files)
    assert got["half"].own_license is None and got["long"].own_license == "BSD-2-Clause"


def test_license_query_paths_and_inheritance(spark, tmp_path):
    notice = "Released under the MIT License."
    rows = [
        (1, notice, "web", "en"),
        (2, "plain prose", "web", "en"),
        (13, "plain prose", "web", "de"),
        (4, "plain prose " * 60 + "\nLicensed under CC BY 4.0.", "web", "en"),
        (5, None, None, None),
        (6, "All rights reserved.", None, None),
        (6, "All rights reserved.", None, None),
        (None, "", "web", "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in licenses.query(spark, str(tmp_path)).drop("own_score").collect())
    assert got == Counter(
        [
            (1, "web/en/LICENSE-1", "MIT", "MIT", None),
            (2, "web/en/2/2", None, "MIT", "web/en"),
            (13, "web/de/3/13", None, None, None),
            (4, "web/en/4/4", "CC-BY-4.0", "CC-BY-4.0", None),
            (5, "none/none/5/5", None, "Proprietary", "none/none"),
            (6, "none/none/LICENSE-6", "Proprietary", "Proprietary", None),
            (6, "none/none/LICENSE-6", "Proprietary", "Proprietary", None),
            (None, None, None, None, None),
        ]
    )


LONG = "<p>" + "A long paragraph, with commas, of some words. " * 8 + "</p>"
ONCE = " ".join(("A long paragraph, with commas, of some words. " * 8).split())
WHOLE_PAGES = {
    f"<body><div class='content has-sidebar'>{LONG}</div><div class=sidebar>Buy this</div>": ONCE,
    f"<body><div id='content' class='no-sidebar'>{LONG}</div>": ONCE,
    f"<article>{LONG}<pre>x = 1 <span class='hljs-comment'># the first</span></pre></article>": f"{ONCE}\nx = 1 # the first",
    f"<div><div>{LONG * 10}</div><div><p>One.</p><p>Two.</p><p>Three.</p></div><h4>Head</h4><ul><li>x</li></ul><table><tr><td>cell</table></div>": "\n".join([ONCE] * 10 + ["One.", "Two.", "Three.", "Head", "x", "cell"]),
    f"<article>{LONG}<ol><li><a href=1>RFC 1</a><li><a href=2>RFC 2</a><li><a href=3>RFC 3</a></ol></article>": f"{ONCE}\nRFC 1\nRFC 2\nRFC 3",
    f"<div>{LONG * 3}</div><ul class=menu><li><a href=1>a</a><li><a href=2>b</a></ul><ul><li><a href=1>c</a><li><a href=2>d</a></ul>": "\n".join([ONCE] * 3),
    f"<article>{LONG * 2}<div class=social>{LONG * 2}</div></article>": "\n".join([ONCE] * 4),
    "<div class=comment>One of two.</div><div class=comment>The other.</div>": "One of two.\nThe other.",
}


def test_attribute_names_are_whole():
    for inner in ("See <a href='/trips/hidden-gems'>the valley</a> now.", "<span data-id='share-12'>a</span> b", "<a href=/p?id=related>c</a>", "<span data-style='display:none' title='x hidden y'>d</span>"):
        want = re.sub("<[^>]*>", "", inner)
        assert pages.extract(f"<article><p>{inner}</p></article>") == want
    assert pages.extract(f"<article><section aria-label='hidden costs'>{LONG}</section></article>") == ONCE
    assert pages.extract(f"<div>{LONG}</div><div>{LONG}</div>") == f"{ONCE}\n{ONCE}"
    assert pages.extract(f"<article>{LONG}<div class='discussion'>{LONG}</div></article>") == f"{ONCE}\n{ONCE}"
    assert pages.extract(f"<div><p>Before.</p><table><tr><td>{LONG}</td></tr></table></div>") == f"Before.\n{ONCE}"
    assert pages.extract(f"<article><p hidden=hidden>x</p>{LONG}<p class='a' class='ad'>y</p></article>") == f"{ONCE}\ny"


def test_page_query_matches_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pages.query(spark, sf).collect()}
    assert got == {r.page_id: (r.url, (t := brute.article(r.html)), len(t)) for r in rows} and len(got) == len(rows)


def test_pages_keep_marked_and_short_text():
    for page, want in WHOLE_PAGES.items():
        assert pages.extract(page) == want


def test_long_items_are_searched_in_segments(spark, monkeypatch):
    item = " ".join(f"i{k}" for k in range(95))
    bench = spark.createDataFrame([(1, item), (2, "i1 i2"), (3, " ".join(["x"] * 30))], "item_id long, text string")
    rows = [(k, f"pad {' '.join(item.split()[k : k + 10])} end") for k in range(86)] + [(100, "x " * 4000 + "y"), (101, "x " * 9)]
    monkeypatch.setattr(decontaminate.segments, "__defaults__", (20,))
    assert decontaminate.segments(bench, 10).count() == 5 + 1 + 2
    for chars in (10**6, 100):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(spark.createDataFrame(rows, DOCS), bench, group_chars=chars).collect()}
        assert got == {**{k: (10, 2 if k <= 1 else 1) for k in range(86)}, 100: (4000, 1), 101: (0, 0)}


def test_benchmark_items_without_id_are_searched(spark):
    item = " ".join(f"i{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"pad {item} pad"), (2, "nothing of it"), (3, "other words of this item")], DOCS)
    bench = spark.createDataFrame([(None, item), (None, "never seen"), (7, "other words"), (7, "this item")], "item_id long, text string")
    for chars in (10**6, 20):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in decontaminate.report(docs, bench, group_chars=chars).collect()}
        none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
        assert got == {1: (12, 0, True, none), 2: (0, 0, False, none), 3: (4, 1, True, seven)}
        assert [r.doc_id for r in decontaminate.clean(docs, bench, group_chars=chars).collect()] == [2]
