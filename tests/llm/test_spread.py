"""What many documents or large ones share does not bring them together."""

from collections import Counter

import numpy as np

from gridcast.llm import near_vectors, ngram_join
from gridcast.llm.words import shingles, word_hashes, words

RULE = ngram_join.Rule(90, 100)


def test_word_hashes_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(5)
    text = b" ".join(bytes(rng.integers(33, 127, rng.integers(1, 300)).astype(np.uint8)) for _ in range(3000)) + b"\t A\x1fB \x0b caf\xc3\xa9 \x0c"
    found = words(text)
    assert word_hashes(text).tolist() == [word_hashes(w)[0] for w in found]
    assert len(set(word_hashes(text).tolist())) == len(set(found))
    giant = b"x" * 700_000
    assert word_hashes(b"one " + giant + b" two").tolist() == [word_hashes(w)[0] for w in (b"one", giant, b"two")]
    assert word_hashes(None).tolist() == word_hashes(b" \n").tolist() == []


def test_a_line_of_most_documents_is_first_in_few(spark):
    line = " ".join(f"line{k}" for k in range(30))
    rows = [(i, line + " " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = set(shingles(word_hashes(line.encode()), 3).view(np.int64).tolist())
    found = ngram_join.signatures(docs, RULE, 3, "doc_id", "text").collect()
    assert all(len(r["keys"]) == RULE.prefix(r.n) for r in found)
    meet = Counter(k for r in found for k in r["keys"] if k in shared)
    assert max(meet.values(), default=0) <= ngram_join.OFTEN


def test_large_sets_of_one_size_are_told_apart_by_their_counts():
    rng = np.random.default_rng(6)
    one, two = (np.sort(rng.integers(0, 1 << 64, 9000, np.uint64)) for _ in range(2))
    near = np.sort(np.concatenate((one[:-200], two[:200])))
    fine = [ngram_join._fine(ngram_join._counts(x)) for x in (one, two, near, one[:300])]
    points = ngram_join._points(fine)
    assert ngram_join._survivors(points[:1], points[1:2], RULE).all()
    i = np.zeros(3, int)
    assert ngram_join._still(fine[:1], fine[1:], i, np.arange(3), RULE).tolist() == [False, True, True]


def test_leaves_of_a_large_tree_meet_once_and_in_several_tasks(spark):
    ids = [[(0, k, 100, 100, [2] * 64, [k], [1], [b""], b"", b"") for k in range(70)], [(1, 7, 100, 100, [2] * 64, [7], [1], [b""], b"", b""), (1, 8, 100, 100, [2] * 64, [8], [2], [b""], b"", b"")]]
    kind = "tree long, leaf long, low long, high long, box array<int>, ids array<long>, marks array<long>, counts array<binary>, shingles binary, bits binary"
    leaf = spark.createDataFrame([r for t in ids for r in t], kind)
    rows = ngram_join.leaf_pairs(leaf, RULE).collect()
    assert sorted((r.tree, r.leaf_a, r.leaf_b) for r in rows) == [(0, a, b) for a in range(70) for b in range(a + 1, 70)] + [(1, 7, 8)]
    assert len({(r._x, r._y) for r in rows if r.tree == 0}) == 9
    assert [(r.leaf_a, r.leaf_b) for r in ngram_join.leaf_pairs(leaf, RULE, marked=True).collect()] == [(7, 8)]


def test_blocks_of_vectors_meet_once_and_send_no_tiles_twice(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 16))
    given = (base[np.arange(900) % 20] + rng.normal(size=(900, 16)) * 0.35 * rng.random((900, 1))).astype(np.float32)
    docs = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(given)], "vec_id long, embedding array<float>, label int")
    want = sorted(near_vectors.near_duplicates(docs).collect())
    sent = near_vectors.squares
    counts = []

    def counted(unit, turned):
        out = sent(unit, turned)
        counts.append((unit.count(), out.count()))
        return out

    monkeypatch.setattr(near_vectors, "squares", counted)
    monkeypatch.setattr(near_vectors, "TILE", 32)
    assert sorted(near_vectors.near_duplicates(docs).collect()) == want
    monkeypatch.setattr(near_vectors, "BLOCK_BYTES", 150 * 64)
    assert sorted(near_vectors.near_duplicates(docs).collect()) == want
    unit = given.astype(np.float64) / np.linalg.norm(given.astype(np.float64), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (np.arange(900)[:, None] % 2 == np.arange(900) % 2)
    assert [r.n_links for r in want] == (links.sum(1) - 1).tolist() and links.sum() > 2000
    assert counts == [(900, 900), (900, 2700)]
