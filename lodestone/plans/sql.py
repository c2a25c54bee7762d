"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from ..functions.text import LEMMAS, SHORT, STOPWORDS, SUFFIXES, TOKEN


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def stem(word: str) -> str:
    """SQL for the stem of a word."""
    base = "CASE " + " ".join(f"WHEN {word} = '{form}' THEN '{to}'" for form, to in LEMMAS.items()) + f" ELSE {word} END"
    rules = []
    for suffix, longer, cut, put, restore in SUFFIXES:
        left = f"substr(b, 1, length(b) - {cut})"
        if restore:
            left = f"CASE WHEN regexp_matches({left}, '(at|iz|bl)$') THEN {left} || 'e' ELSE {left} END"
        elif put:
            left = f"{left} || '{put}'"
        rules.append(f"WHEN ends_with(b, '{suffix}') AND length(b) > {longer} THEN {left}")
    return f"(SELECT CASE WHEN length(b) <= {SHORT} THEN b {' '.join(rules)} ELSE b END FROM (SELECT {base} AS b))"


def terms(table: str, id_col: str, text: str) -> str:
    """SELECT of (id, term): a row for each stemmed term occurrence."""
    rows = f"SELECT {id_col}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS word FROM {table}"
    base = "CASE " + " ".join(f"WHEN word = '{form}' THEN '{to}'" for form, to in LEMMAS.items()) + " ELSE word END"
    rules = stem("b0").split(" FROM (SELECT ")[0].removeprefix("(SELECT ")
    return f"SELECT {id_col}, {rules} AS term FROM (SELECT {id_col}, {base} AS b FROM ({rows}) WHERE length(word) > 1 AND word NOT IN ({quoted(STOPWORDS)}))"
