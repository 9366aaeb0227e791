"""Brute-force versions of the operators' results, and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty, white space, ties, a repeated row, beyond the BMP, one very long text, clashing columns.
ODD = [(1, None, "en", 7), (2, "", None, 7), (3, " \n\t ", "en", 7), (4, "same text of a few words", "en", 7), (5, "same text of a few words", "de", 7),
       (4, "same text of a few words", "en", 7), (6, "日本語 😀 tēxt", "xx", None), (None, "no id here at all", "en", 7),
       (7, "word " * 60_000 + "token=abcdefghijklmnop end", "en", 7)]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    split = lambda t: PLAIN.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i: i + 13])].add(str(item))
    for doc, text in docs:
        w, hit, named = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k: k + n])):
                    hit.update(range(k, k + n))
                    named |= found
        yield doc, len(w), len(hit), len(named), sha(",".join(sorted(named)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)


def base_features(text):
    text = text or ""
    w = SPACED.findall(text)
    times = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if times[tuple(w[i: i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_components(rows):
    sets, held = {i: shingles(t) for i, t in rows}, defaultdict(set)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in held[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_tokens long").withColumnRenamed("n_tokens", "n_words")
