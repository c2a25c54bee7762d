"""Spelling variants and the divergence audit, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence_audit, spelling_variants

from .conftest import folder, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute_variants(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form, many = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        many[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n, many[w], words.get(form[w]))] += 1
    return out


@pytest.fixture(scope="module")
def spelled(odd_rows):
    """The odd rows; words with variants in chains, at both ends, doubled letters, and one half that many words share."""
    r = random.Random(9)
    base = ["mississippi", "übergrößen", "aaaaaaaa", "connection", "spelling", "variants"]
    words = []
    for w in base:
        words += [w] * 300
        for _ in range(40):
            at, c = r.randrange(len(w) + 1), r.choice("abcdestüßz")
            one = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words += [one] * r.choice((1, 2, 12, 25))
            at = r.randrange(len(one))
            words += [one[:at] + one[at + 1 :]] * r.choice((1, 2))
    words += [f"prefix{''.join(r.choice('ab') for _ in range(r.randint(1, 6)))}" for _ in range(400)]
    words += [f"{''.join(r.choice('ab') for _ in range(r.randint(1, 6)))}suffix" for _ in range(400)]
    words += ["y" * 3000, "y" * 2999, "y" * 2999, "Y" * 3000]
    r.shuffle(words)
    return [(x[0], x[1]) for x in odd_rows] + [(100 + i, " ".join(words[i::40])) for i in range(40)]


@pytest.mark.parametrize("size", [8192, 30])
def test_spelling_variants(spark, spelled, size):
    docs = spark.createDataFrame(spelled, "doc_id long, text string")
    got = Counter(tuple(r) for r in spelling_variants.variants(docs, size).collect())
    expected = brute_variants(spelled)
    assert got == expected
    assert max(r[4] for r in expected) > 5 and any(r[1] and r[2] != r[1] for r in expected)


def test_spelling_variants_odd(spark, none, clashing, odd_rows, tmp_path):
    assert spelling_variants.variants(none).count() == 0
    got = Counter(tuple(r) for r in spelling_variants.op12_spelling_variants(spark, folder(clashing, tmp_path)).collect())
    assert got == brute_variants([(r[0], r[1]) for r in odd_rows])


def test_search_schemes():
    r = random.Random(1)
    for letters in ("ab", "abé"):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(200)})
        index, got = spelling_variants.BidirectionalIndex(words), []
        for suffix in (False, True):
            for longer in (0, 1):
                asked = np.array([i for i, w in enumerate(words) if len(w) >= 7 + longer])
                got += list(zip(*(x.tolist() for x in index.near(asked, suffix, longer)), strict=True))
        assert sorted(got) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]


def test_rank_table_counts_patterns():
    index = spelling_variants.BidirectionalIndex(["banana", "bandana", "cabana"])
    text = "\nbanana\nbandana\ncabana\n\0"
    codes = {c: i for i, c in enumerate(sorted(set(text)))}
    for pattern in ("ana", "an", "ban", "\nban", "ana\n", "xan"):
        if set(pattern) <= set(codes):
            one = np.array([0]), np.array([0]), np.array([len(text)])
            for c in reversed(pattern):
                one = index.left.extended(*one, np.array([codes[c]]))
            other = np.array([0]), np.array([0]), np.array([len(text)])
            for c in pattern:
                other = index.right.extended(*other, np.array([codes[c]]))
            times = len(re.findall(f"(?={pattern})", text))
            assert one[2][0] == other[2][0] == times and (one[0][0], one[1][0]) == (other[1][0], other[0][0])


def brute_audit(rows, least=3, ranks=200):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)), lang or "", source or "") for t, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in docs:
        df[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = Counter()
    for lang, sources in groups.items():
        kept = [w for w, n in df[lang].items() if n >= least]

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= ranks:
                        out[(lang, s, part, item, value, rank)] += 1
    return out


@pytest.fixture(scope="module")
def sourced(odd_rows):
    r = random.Random(3)
    words = prose(50, 60).split() + ["Über", "Ñandú", "x\x00y", "naïve"]
    rows = [(x[1], x[2], x[3]) for x in odd_rows]
    for n in range(60):
        lang = r.choice(["en", "en", "fr", None, ""])
        rows.append((" ".join(r.choice(words[: 20 + n % 40]) for _ in range(30)), lang, r.choice(["a", "b", "c", None, "é"])))
    return [*rows, ("1 2 3", "xx", "digits"), (None, "yy", "p"), (None, "yy", "q")]


@pytest.mark.parametrize("vocabulary", [2_000_000, 15])
def test_audit(spark, sourced, vocabulary):
    docs = spark.createDataFrame(sourced, "text string, lang string, source string")
    got = Counter(tuple(r) for r in divergence_audit.audit(docs, vocabulary=vocabulary).collect())
    assert got == brute_audit(sourced)
    ranked = Counter(tuple(r) for r in divergence_audit.audit(docs, ranks=3, vocabulary=vocabulary).collect())
    assert ranked == brute_audit(sourced, ranks=3)


def test_audit_odd(spark, none, clashing, odd_rows, tmp_path):
    assert divergence_audit.audit(none).count() == 0
    got = Counter(tuple(r) for r in divergence_audit.op13_divergence_audit(spark, folder(clashing, tmp_path)).collect())
    assert got == brute_audit([(r[1], r[2], r[3]) for r in odd_rows])
    lone = spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string")
    assert divergence_audit.audit(lone).count() == 0


def test_audit_fits_see_terms_not_tokens(spark, monkeypatch):
    seen = []

    class Watched(divergence_audit.CountVectorizer):
        def fit(self, rows):
            model = super().fit(rows)
            seen.append((rows.agg(F.sum(F.size("terms"))).first()[0], len(model.vocabulary)))
            return model

    monkeypatch.setattr(divergence_audit, "CountVectorizer", Watched)
    words = prose(600, 7).split()
    words = [f"{w}{a}{b}" for w in words[:8] for a in "abcdefgh" for b in "abcdefgh"]
    r = random.Random(13)
    rows = [(" ".join(r.choices(words, k=400)), "en", "ab"[n % 2]) for n in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {(x.source, x.term): x.c for x in divergence_audit.cells(docs, vocabulary=200).collect()}
    expected = Counter((source, w) for text, _, source in rows for w in text.split())
    assert found == expected
    tokens, tasks = 200 * 400, int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(seen) > 1 and max(kept for _, kept in seen) <= 400
    assert sum(n for n, _ in seen) <= min(tokens / 2, 3 * (tasks + 1) * len(set(words)))
