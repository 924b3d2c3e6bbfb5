"""Plain versions of the corpus operators, to hold them against."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def quality(t):
    t = t or ""
    ws = words(t)
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {p for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    m = {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_bangs": t.count("!"),
        "n_lines": len(lines),
    }
    n = m["n_words"]
    fails = [
        n < 50,
        100 * m["n_repeat_words"] > 50 * n,
        10 * m["n_symbols"] > n,
        10 * m["n_bangs"] > n,
        m["word_chars"] < 2 * n or m["word_chars"] > 20 * n,
        10 * m["n_dup_lines"] > 5 * m["n_lines"],
    ]
    m["fail_bits"] = sum(1 << i for i, f in enumerate(fails) if f)
    return m


def line_dedup(docs, min_words=5):
    """docs: (id, text) in order; the texts without later copies of repeated runs."""
    seen, gone = {}, defaultdict(set)
    for d, (_, t) in enumerate(docs):
        if t is None:
            continue
        ls = t.split("\n")
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                if sum(len(words(x)) for x in ls[i : j + 1]) >= min_words:
                    key = tuple(ls[i : j + 1])
                    if key in seen:
                        gone[d].update(range(i, j + 1))
                    else:
                        seen[key] = (d, i)
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, (_, t) in enumerate(docs)], [len(gone[d]) for d in range(len(docs))]


def shingles(t, k=5):
    ws = [w.lower() for w in words(t)]
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def jaccard(docs, min_j=0.8):
    """(class, links) per document of (id, text): the least index of its class, and how many others are linked."""
    sets = [shingles(t) for _, t in docs]
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(docs))], links


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(t):
    return ITEM_WORD.findall((t or "").translate(LOWER))


def contamination(t, items, window=10):
    """(words, hit words, sorted ids of items that occur)."""
    ws = item_words(t)
    hit, who = set(), set()
    for item, text in items:
        iw = item_words(text)
        if not iw:
            continue
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1):
            for at in range(len(ws) - m + 1):
                if ws[at : at + m] == iw[i : i + m]:
                    hit.update(range(at, at + m))
                    who.add(str(item))
    return len(ws), len(hit), sorted(who)


def targets(sizes, weights=(1, 2, 3), cap=3):
    """sizes: source -> words; the targets by water filling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def mix(docs, seed="mix-1"):
    """docs: (id, source, text); times taken per document."""
    size = [len(words(t)) for _, _, t in docs]
    sums = defaultdict(int)
    for (_, s, _), n in zip(docs, size):
        sums[s] += n
    target = targets(dict(sums))
    turn = [hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest() for d, _, _ in docs]
    key = lambda s: "1" if s is None else "0" + s
    order = sorted(range(len(docs)), key=lambda i: (key(docs[i][1]), turn[i], size[i]))
    upto, rounds = defaultdict(int), []
    for i in order:
        s = docs[i][1]
        upto[s] += size[i]
        if size[i]:
            rounds += [((r * sums[s] + upto[s]) / target[s], key(s), turn[i], size[i], i) for r in range(3)]
    used, taken = 0, [0] * len(docs)
    for _, _, _, n, i in sorted(rounds):
        used += n
        if used > sum(sums.values()):
            break
        taken[i] += 1
    return size, target, taken


def cosine(line, template, idf, other):
    terms = lambda x: Counter(re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", x.lower()))
    a, b = terms(line), terms(template)
    va, vb = ({t: n * idf.get(t, other) for t, n in v.items()} for v in (a, b))
    norm = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(va[t] * vb.get(t, 0) for t in va) / norm if norm else 0.0


class Article(HTMLParser):
    """The blocks of a page's article elements, of nothing else; for pages that mark their article."""

    INLINE = frozenset("a b i em strong span code small sub sup u br".split())
    AWAY = frozenset("script style nav footer aside form".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.away = 0
        self.blocks, self.part = [], []

    def flush(self):
        if line := " ".join("".join(self.part).split()):
            self.blocks.append(line)
        self.part = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.away += tag in self.AWAY
        if tag == "br":
            self.part.append(" ")
        elif tag not in self.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        self.inside -= tag == "article"
        self.away -= tag in self.AWAY

    def handle_data(self, data):
        if self.inside > 0 and not self.away:
            self.part.append(data)


def article(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


def lloyd(rows, k=16, rounds=3):
    """Plain Lloyd rounds in Python integers."""
    most = 2**27
    points = [(d, tuple(max(-most, min(most, math.floor(64 * x))) for x in v)) for d, v in rows]
    first = sorted((d is None, hashlib.sha256(f"1:{d}".encode()).hexdigest() if d is not None else "", p) for d, p in points)
    heads = [p for _, _, p in first[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(heads))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, p in points:
            own[nearest(p)[1]].append(p)
        heads = [tuple(sum(x) // len(own[i]) for x in zip(*own[i])) if own[i] else c for i, c in enumerate(heads)]
    found = [(d, *nearest(p)) for d, p in points]
    sums = Counter()
    for _, gap, i in found:
        sums[i] += gap
    top = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in heads]
    return [(d, i, gap, min(top, sums[i]), min(top, sum(sums.values())), digest[i]) for d, gap, i in found]


def near(a, b):
    """Whether one code point inserted, deleted or replaced makes *a* of *b*."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(t):
    """The rules' spans, as written."""
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in twice) % 10 == 0)
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def enumerated(unary, ends, pots):
    """Label probabilities by summing over all labellings."""
    n, labels = len(unary), len(unary[0])
    sums = [[0.0] * labels for _ in range(n)]
    for y in itertools.product(range(labels), repeat=n):
        p = math.exp(sum(unary[i][y[i]] for i in range(n)) + sum(q[y[a]][y[b]] for (a, b), q in zip(ends, pots)))
        for i in range(n):
            sums[i][y[i]] += p
    return [[x / sum(row) for x in row] for row in sums]


def toxicity(bags, labels, steps, size, dim, batch=64, seed=5, least=3, l2=1e-5, power=0.5):
    """A plain trainer of the subword-bag model, number by number: (weight per bucket, bias)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n = Counter(b for bag in bags for b in bag)
    start = rng.normal(0, 0.1, (size, dim))
    emb = {b: [float(np.float32(x)) for x in start[b]] for b in sorted(n) if n[b] >= least}
    out = [[float(np.float32(x)) for x in row] for row in rng.normal(0, 0.1, (dim, 2))]
    bias = [0.0, 0.0]
    weigh = [(len(labels) / 2 / labels.count(k)) ** power for k in (0, 1)]
    moments = defaultdict(lambda: [0.0, 0.0])

    def update(name, value, g, t, rate):
        m = moments[name]
        m[0] += 0.1 * (g - m[0])
        m[1] += 0.01 * (g * g - m[1])
        return value - rate * (m[0] / (1 - 0.9**t)) / (math.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)

    t = 0
    while t < steps:
        order = rng.permutation(len(bags))
        rate = 0.02 * max(0.0, 1 - t / steps) + 0.002
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            g_emb, g_out, g_bias = defaultdict(lambda: [0.0] * dim), [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
            for k in own:
                known = [b for b in bags[k] if b in emb]
                share = 100 / max(1, len(bags[k]))
                mean = [share * sum(emb[b][d] for b in known) for d in range(dim)]
                z = [sum(mean[d] * out[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
                e = [math.exp(x - max(z)) for x in z]
                err = [(e[c] / sum(e) - (labels[k] == c)) * weigh[labels[k]] / len(own) for c in (0, 1)]
                for c in (0, 1):
                    g_bias[c] += err[c]
                    for d in range(dim):
                        g_out[d][c] += mean[d] * err[c]
                for b in known:
                    for d in range(dim):
                        g_emb[b][d] += share * sum(err[c] * out[d][c] for c in (0, 1))
            t += 1
            emb = {b: [update(("e", b, d), x, g_emb[b][d] + l2 * x, t, rate) for d, x in enumerate(v)] for b, v in emb.items()}
            out = [[update(("o", d, c), x, g_out[d][c], t, rate) for c, x in enumerate(row)] for d, row in enumerate(out)]
            bias = [update(("b", c), x, g_bias[c], t, rate) for c, x in enumerate(bias)]
    return {b: 100 * sum(v[d] * (out[d][1] - out[d][0]) for d in range(dim)) for b, v in emb.items()}, bias[1] - bias[0]
