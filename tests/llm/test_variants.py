"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from gridcast.llm import variants
from gridcast.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5, least=5):
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows(frame):
    found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("block", [variants.BLOCK, 4])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    # With small blocks, windows are cut down to single places.
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "ALPHABET", 2)
    monkeypatch.setattr(variants, "TILE", 3)
    rng = random.Random(block)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(500)}
    words |= {"a" * 6, "a" * 7, "a" * 8, "ÿ" * 40, "ÿ" * 41, "ÿ" * 39 + "a"}
    counts = {w: rng.choice([1, 5, 6, 30, 31, 160, 900]) for w in sorted(words)}
    made = spark.createDataFrame([*counts.items(), (None, 7), ("nullcount", None)], "word string, n long")
    got = rows(variants.group(made))
    assert got == brute(counts)
    assert any(f and r != f for _, f, r, *_ in got)


def test_query_equals_brute_force(spark, data):
    counts = Counter()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    assert rows(QUERIES["op12_spelling_variants"](spark, data)) == brute(counts)


def test_odd_tables(spark, odd_docs):
    counts = {r.word: r.n for r in variants.word_counts(odd_docs, least_chars=1).collect()}
    want = Counter()
    for r in odd_docs.collect():
        want.update(w for w in re.findall("[a-zÀ-ÿ]+", (r.text or "").lower()))
    assert counts == dict(want)
    assert variants.word_counts(odd_docs.limit(0)).count() == 0
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.group(empty).collect() == []
    alone = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert rows(variants.group(alone)) == {("lonely", None, "lonely", 9, 0, None)}
