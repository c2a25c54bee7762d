"""Secret scans: fixed patterns, and a guess-cost measure of what stands where a credential would.

Patterns find assignments, access keys and long hex strings. Besides, every value that stands in a credential's place
(after a word such as pwd, auth or key, any blanks and a sign of assignment; in quotes up to the closing one, else up
to a blank or mark) is measured: the cost to guess it is that of its cheapest segmentation into known words, dates,
repeats, keyboard walks and spans that only brute force finds, found by dynamic programming. Values that cost at least
10^STRONG guesses are spans of kind ``guess``.

The known words are the commonest passwords and, after them, the words of a public tokenizer's vocabulary in the order
of their merges, which is about that of their frequency; its path is a parameter, and the ranks travel with the job.

Spans are (kind, start, end, log10 of the guesses or null) in code points, end exclusive. Defined results for odd
input: a null or empty text has no spans; texts of any length are scanned whole and row by row; an empty table gives an
empty result; other columns are carried along, and one named spans is replaced.
"""

from __future__ import annotations

import base64
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

STRONG = 10.0

#: The patterns of the base kinds, and how long (group, characters) a match must be.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 18),
    ("hex", r"[0-9a-f]{16,}", re.ASCII, 0, 16),  # runs are maximal, so short ones need not be matched to be dropped
)
KINDS = tuple(kind for kind, *_ in BASE) + ("guess",)

#: A credential word with the sign of assignment after it, and the value taken then: quoted, or a run of other characters.
SIGN = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|login|pin|(?:api|access|private|client)[_-]?key)[\"']?\x20*[:=]\x20*"
VALUE = r"\"([^\"\n]{6,})\"|'([^'\n]{6,})'|[\"']?([^\s\"'<>,;]{6,})"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Words that guessers try before those of the vocabulary, commonest first.
WORDS = tuple(
    """password qwerty love admin welcome monkey dragon master login princess sunshine shadow football baseball secret
    letmein iloveyou trustno superman batman michael jordan hunter soccer hockey killer changeme passw0rd abc starwars
    computer internet server database system root user guest test demo default token access private public""".split()
)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")  # a keyboard's
_LEET = str.maketrans("4301$5@7!", "aeolssati")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d)")
_DATE_LENGTHS = (4, 8, 10)
LONGEST_WORD = 16
_CLASSES = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))


def _brute(c: str) -> float:
    return math.log10(next((n for f, n in _CLASSES if f(c)), 33))


def ranked_words(vocabulary: bytes) -> dict[str, int]:
    """Rank of each known word: WORDS, and then the vocabulary's tokens of three small letters or more."""
    tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower() for line in vocabulary.splitlines() if line)
    words = dict.fromkeys([*WORDS, *(t for t in tokens if len(t) >= 3 and t.isascii() and t.isalpha())])
    return {w: n + 1 for n, w in enumerate(words)}


def _known(part: str, ranks: dict[str, int]) -> float | None:
    """log10 of the guesses for a known word or a date, if part is one."""
    low = part.lower()
    rank = ranks.get(low)
    leet = None if rank else ranks.get(low.translate(_LEET))
    if rank or leet:
        variants = 1 if part == low else 2 if part in (low.capitalize(), low.upper()) else 2 ** sum(c.isupper() for c in part)
        return math.log10((rank or leet) * variants * (4 if leet else 1))
    if len(part) in _DATE_LENGTHS and _DATE.fullmatch(part):
        return math.log10(120.0 if len(part) == 4 else 365.0 * 120 * (1 if len(part) == 8 else 5))
    return None


STEP = math.log10(5)  # a further segment: the choice of its kind
REPEAT, WALK = 0.3, math.log10(47) + 0.3  # what the first character of a repeat costs above brute force, and of a walk in all
REPEATED, WALKED = 0.05, 0.15  # each further one


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs.

    A segment costs the logarithm of its guesses, and each after the first a further step for the choice of its kind.
    Repeats and walks may be of any length: what they cost grows by a constant for each further character, so they are
    carried as states along the value; words and dates are short. The work is linear in the length of the value.
    """
    far = math.inf
    longest = max(LONGEST_WORD, *_DATE_LENGTHS)
    best = 0.0  # of value[:i]
    ends = [0.0]
    brute = repeat = walk = far  # cheapest segmentation of value[:i] whose last segment is of this kind and still open
    for i, c in enumerate(value):
        begin = best + (STEP if i else 0.0)
        one = _brute(c)
        same, near = i and c == value[i - 1], i and (value[i - 1].lower(), c.lower()) in _NEXT
        brute = min(brute, begin) + one
        repeat = min(repeat + REPEATED if same else far, begin + one + REPEAT)
        walk = min(walk + WALKED if near else far, begin + WALK)
        now = min(brute, repeat, walk)
        for size in range(3, min(i + 1, longest) + 1):
            cost = _known(value[i + 1 - size : i + 1], ranks)
            if cost is not None:
                now = min(now, ends[i + 1 - size] + cost + (STEP if i + 1 > size else 0.0))
        ends.append(now)
        best = now
    return best


_COMPILED = tuple((kind, re.compile(p, flags), group, least) for kind, p, flags, group, least in BASE)
_SIGN, _VALUE = (re.compile(p, re.ASCII | re.IGNORECASE) for p in (SIGN, VALUE))


def find_spans(text: str | None, ranks: dict[str, int], strong: float = STRONG) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text, by start and then by kind."""
    text = text or ""
    out = [(kind, m.start(), m.end(), None) for kind, pattern, group, least in _COMPILED for m in pattern.finditer(text) if len(m[group]) >= least]
    done = 0  # end of the last value: values do not overlap
    for sign in _SIGN.finditer(text):
        m = sign.start() >= done and _VALUE.match(text, sign.end())
        if m:
            group = m.lastindex
            done, cost = m.end(group), guess_cost(m[group], ranks)
            if cost >= strong:
                out.append(("guess", m.start(group), m.end(group), cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("guesses", T.DoubleType())])


def spans_of(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The spans of a text. The vocabulary is read on the driver."""
    with open(vocabulary, "rb") as f:
        ranks = ranked_words(f.read())

    @F.pandas_udf(T.ArrayType(_SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b, "guesses": g} for k, a, b, g in find_spans(t, ranks)])

    return spans(text)


def secret_spans(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with their spans."""
    return docs.withColumn("spans", spans_of(F.col("text"), vocabulary))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    n = {kind: F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS}
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[n[kind] for kind, *_ in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n["guess"])
