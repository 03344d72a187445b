import hashlib
import random
import textwrap
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridcast.llm import bpe, graph, imatch, langid, licenses, mixing, near_vectors, ngram_join, quality_fm, sharding, spans

DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in graph.components(docs_of(spark, links, "u long, v long")).collect()}
    pairs = [(a, b) for a, b in links if b is not None and a != b]
    want = closure(range(300), pairs)
    touched = {x for p in pairs for x in p}
    assert got == {n: want[n] for n in touched}


# ---- near vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = base[i % 12] + rng.normal(size=16) * 0.3 * rng.random()
        rows.append((1000 - i, [float(x) for x in v], i % 3 if i % 17 else None))
    rows += [(2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], 0), (2005, [], 1), (2006, [1.0, None] * 8, 1)]
    got = near_vectors.near_duplicates(docs_of(spark, rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for k, a in enumerate(good):
        for b in good[k + 1 :]:
            if a[2] == b[2]:
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a[0], b[0]))
    roots = closure([r[0] for r in rows], links)
    degree = Counter(x for p in links for x in p)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(r[0], degree[r[0]], roots[r[0]], roots[r[0]] == r[0]) for r in rows}
    assert len(links) > 50


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 0.0, 1e-200]), (2, [5e-324, 0.0, 5e-324]), (3, [1e200, 0.0, 1e200]), (4, [1e200, 0.0, 1.01e200])]
    rows += [(5, [1.7e308, 1.7e308, 0.0]), (6, [3.0, 3.0, 0.0]), (7, [0.0, 1.0, -1.0]), (None, [1.0, 0.0, 1.0]), (8, [2.0, 0.0, 2.0]), (8, [2.0, 0.0, 2.0])]
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, rep string, v string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame, 0.93).collect()}
    alike = {i: (4, 1) for i in (1, 2, 3, 4, 8)}
    assert got == {**alike, 5: (1, 5), 6: (1, 5), 7: (0, 7), None: (0, None)}
    assert near_vectors.near_duplicates(frame.limit(0), 0.93).collect() == []


def test_bound_never_drops_a_pair():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(80, 24)) * np.linspace(2, 0.1, 24)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    i, j = near_vectors.survivors(a, a, 0.6)
    want = set(zip(*np.nonzero(a @ a.T >= 0.6), strict=True))
    assert want <= set(zip(i, j, strict=True))


# ---- spans


def spans_brute(rows):
    seen, cover = set(), defaultdict(set)
    for key, text in sorted(rows):
        for digest, begin, end in spans.runs(spans.sentences(text.encode())):
            if digest in seen:
                cover[key].update(range(begin, end))
            seen.add(digest)
    return cover


def test_a_line_repeated_in_a_document_is_sent_once():
    found = [(7, 0, 3), (7, 1, 4), (8, 2, 5), (7, 5, 8), (7, 6, 9), (9, 20, 23), (8, 30, 33)]
    got = list(spans.own_first(iter(found)))
    assert [g for g in got if g[0] is not None] == [(7, 0, 3), (8, 2, 5), (9, 20, 23)]
    later = {i for h, a, b in got if h is None for i in range(a, b)}
    assert later == {i for n, (h, a, b) in enumerate(found) if h in {x[0] for x in found[:n]} for i in range(a, b)}
    assert list(spans.own_first(iter([]))) == []


def test_spans_against_one_pass(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(2, 40))) + rng.choice([". ", "! ", "\n"])
    passages = ["".join(sentence() for _ in range(5)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([sentence(), sentence(), rng.choice(passages)]) for _ in range(12))) for i in range(120)]
    got = {r.doc_id: r for r in spans.dedup(docs_of(spark, rows).repartition(7)).collect()}
    cover = spans_brute(rows)
    for key, text in rows:
        pieces = spans.sentences(text.encode())
        assert got[key].text == b"".join(p for i, (p, _) in enumerate(pieces) if i not in cover[key]).decode()
        assert got[key].n_removed == len(cover[key])
    assert sum(len(c) for c in cover.values()) > 100


def test_passage_of_one_long_sentence_is_caught(spark):
    passage = " ".join(f"p{i}" for i in range(52)) + "."
    rows = [(1, "Some other words here. " + passage + " And an end."), (2, "Quite a different start. " + passage + " It stops.")]
    got = {r.doc_id: r.text for r in spans.dedup(docs_of(spark, rows)).collect()}
    assert got[1] == rows[0][1] and passage not in got[2] and got[2].startswith("Quite a different start.")


def test_passages_pasted_anywhere_in_a_sentence_against_words(spark):
    rng = random.Random(9)
    words = lambda n, stops: [f"v{rng.randrange(4000)}" + (rng.choice([". ", "! ", "\n"]) if rng.random() < stops else " ") for _ in range(n)]
    rows, pasted = [], []
    for i in range(80):
        stops = (0.0, 0.03, 0.15)[i % 3]
        passage = words(rng.randint(51, 81), stops)
        for key in (2 * i, 2 * i + 1):
            head, tail = words(rng.randint(3, 70), stops), words(rng.randint(3, 70), stops)
            rows.append((key, "".join(head + passage + tail)))
        pasted.append((2 * i + 1, passage))
    got = {r.doc_id: r.text for r in spans.dedup(docs_of(spark, rows)).collect()}
    seen, share, repeated = set(), [], {}
    for key, text in rows:
        told = [w.rstrip(".!") for w in text.split()]
        repeated[key] = {j for k in range(len(told) - 19) if tuple(told[k : k + 20]) in seen for j in range(k, k + 20)}
        seen |= {tuple(told[k : k + 20]) for k in range(len(told) - 19)}
    for key, passage in pasted:
        assert got[key - 1] == rows[key - 1][1]
        before, after = rows[key][1].split(), Counter(got[key].split())
        gone = Counter(before) - after
        # What goes is repeated, and most of it goes: the ends share a piece with the host's words.
        assert not gone - Counter(before[j] for j in repeated[key])
        share.append(sum(gone.values()) / len(passage))
    assert min(share) > 0.3, sorted(share)[:5]
    assert sum(share) / len(share) > 0.8


def test_a_short_piece_at_the_end_of_a_repeated_run_goes_too():
    piece = lambda c, n: (b"", [b"%s%d" % (c, i) for i in range(n)])
    got = [(b, e) for _, b, e in spans.runs([piece(b"a", 9), piece(b"b", 9), piece(b"c", 4), piece(b"d", 4), piece(b"e", 9)])]
    assert got == [(0, 3), (0, 4), (1, 5)]


def test_rows_without_an_id_and_rows_that_share_one(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(" ".join(f"x{rng.randrange(10**6)}" for _ in range(9)) + ". " for _ in range(n))
    passage, clean = prose(4), prose(9)
    twice = [passage + prose(3) for _ in range(2)]
    copies = prose(5)
    rows = [(1, passage + prose(2)), (None, passage + "An end."), (None, clean), (5, clean[:40] + prose(4)), (7, prose(6)), (7, twice[0]), (7, twice[1])]
    rows += [(None, copies), (None, copies), (9, copies + "New words."), (9, copies + "New words.")]
    got = sorted((r.doc_id or 10**9, r.text) for r in spans.dedup(docs_of(spark, rows).repartition(5)).collect())
    want = [(k, t) for k, t in rows[2:5]] + [rows[0], (None, "An end."), (7, twice[0][len(passage) :]), (7, twice[1][len(passage) :])]
    want += [(None, ""), (None, ""), (9, copies + "New words."), (9, "")]
    assert got == sorted((k or 10**9, t) for k, t in want)


def test_sentences_make_up_the_text():
    for text in ("", " ", "\n\n a. b! c", "a" * 100, "A. \n\n B?\tC " + "w " * 50, "  lead. x"):
        assert b"".join(p for p, _ in spans.sentences(text.encode())) == text.encode()


# ---- fingerprints


def test_edited_text_and_equal_fingerprints(spark):
    rows = [(i * 3 % 101, f"text number {i % 40} with common words and rare{i % 9} ones é🙂") for i in range(101)]
    got = {r.doc_id: r for r in imatch.fingerprints(docs_of(spark, rows).repartition(5)).collect()}
    ordered = sorted(rows)
    for at, (key, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        half = len(text) // 2
        assert got[key].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert got[key].n_chars == len(text)
        parts = [got[k].fingerprint.split(".") for k in (key, ordered[(at + 1) % len(ordered)][0])]
        used = [(x, y) for x, y in zip(*parts, strict=True) if (x, y) != ("-", "-")]
        assert got[key].near_next == pytest.approx(sum(x == y for x, y in used) / len(used))
    by_text = defaultdict(set)
    for key, text in rows:
        by_text[text].add(got[key].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


# ---- licenses


def test_licenses_and_their_versions(spark):
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nMore."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (5, "A license to thrill is no license."),
        (6, None),
        (7, "this work IS licensed under the gnu general public license version 3 and more"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: ["GPL-3.0"], 3: ["GPL-2.0"], 4: ["Apache-2.0", "CC-BY-NC-4.0"], 5: [], 6: [], 7: ["GPL-3.0"]}


def test_every_template_wrapped_and_commented():
    before, after = "Some words of the file come first. " * 9, "\n\nint main() { return 0; } // and so on\n" * 9
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for width in range(60, 81, 4):
                for prefix in ("", "# ", " * ", "// "):
                    wrapped = "\n".join(prefix + line for line in textwrap.wrap(text, width - len(prefix)))
                    got = licenses.notices(f"{before}\n{wrapped}{after}")
                    assert [(n[0], n[2]) for n in got] == [(name, 1.0)], (text, width, prefix)


def test_each_of_many_notices_counts_once(spark):
    lines = ["Licensed under CC BY 4.0.", "Released under the MIT License."] * 40
    lines[71] = "Released under the BSD License."
    long_ = licenses.TEMPLATES["Apache-2.0"][1]
    rows = [(1, "\n".join(lines)), (2, "\n".join([long_] * 30)), (3, "word " * 180 + ("Released under the MIT License. " + "word " * 40) * 9)]
    got = {r.doc_id: (Counter(n.license for n in r.notices), r.n_notices) for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: ({"CC-BY-4.0": 40, "MIT": 39, "BSD": 1}, 80), 2: ({"Apache-2.0": 30}, 30), 3: ({"MIT": 9}, 9)}


def test_cue_words_on_two_lines(spark):
    rows = [(1, "/* This is free and unencumbered software released into the public\n * domain. */")]
    assert [r.licenses for r in licenses.scan(docs_of(spark, rows)).collect()] == [["Unlicense"]]


# ---- mixing


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000)]
    leaves = docs_of(spark, rows, "domain string, language string, origin string, tokens long")
    got = {(r.domain, r.language): r.quota for r in mixing.budgets(leaves, 0.1, 1, {"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}


# ---- tokens


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.fst.ranks, special_tokens={})


def test_ids_are_the_librarys(codec, library, spark):
    rng = random.Random(5)
    pool = "abc é  \n\t'stll 0123 ß中文字🙂 \x1c_-..!?ABC thetheer"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ["a" * 20_000]
    for text in texts:
        ids = codec.encode(text or "")
        assert array("I", ids).tolist() == library.encode_ordinary(text or "")
        assert "".join(bpe.decode_stream(codec, ids, 3)) == (text or "")


def test_tokens_leave_before_the_end(codec):
    given = 0

    def source():
        nonlocal given
        for byte in b"hello world and more" * 50:
            given += 1
            yield byte

    stream = codec.fst.stream(source())
    next(stream)
    assert given < 60


# ---- quality and language


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_fm.learn(docs, labels)
    scored = quality_fm.score(docs, machine).join(labels, "doc_id").where(quality_fm.held_out()).toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.98
    index, value = quality_fm.features(b"some words of a text", 20, quality_fm.WordHashes())
    inner = machine.factors[index] * value[:, None]
    pairs = sum(float(inner[i] @ inner[j]) for i in range(len(index)) for j in range(i))
    assert machine.margin(index, value) == pytest.approx(machine.bias + machine.weights[index] @ value + pairs)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98
    assert model.predict("123 !!")[0] == langid.UNKNOWN


# ---- n-gram join


def jaccard_brute(rows, num, den, size):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = frozenset(tuple(w[x : x + size]) for x in range(max(1, len(w) - size + 1))) if w else frozenset()
    links = []
    keys = sorted(sets)
    for at, a in enumerate(keys):
        for b in keys[at + 1 :]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                links.append((a, b))
    roots, degree = closure(keys, links), Counter(x for p in links for x in p)
    return {k: (len(sets[k]), roots[k], degree[k]) for k in keys}


@pytest.mark.parametrize(("num", "den", "size"), [(90, 100, 3), (80, 100, 5)])
def test_ngram_join_against_all_pairs(spark, num, den, size):
    rng = random.Random(6)
    rows, key = [], 0
    for n in (3, 20, 60, 150):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(n)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            key += 1
            rows.append((key * 7 % 1009, " ".join(w)))
    rows += [(2001, None), (2002, ""), (2003, "a"), (2004, "A")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(docs_of(spark, rows).repartition(3), num, den, size).collect()}
    assert got == jaccard_brute(rows, num, den, size)


# ---- sharding


def test_table_is_even_and_steady():
    before, after = sharding.fill(sharding.SHARDS), sharding.fill(sharding.SHARDS[:-1])
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != sharding.SHARDS[-1])
    assert moved < 0.05 * len(before)


def test_slots_are_filled_in_turns():
    names, size = ["b", "a", "c"], 101
    wishes = {}
    for n in names:
        at, skip = xxhash.xxh3_64_intdigest(n, seed=1) % size, xxhash.xxh3_64_intdigest(n, seed=2) % (size - 1) + 1
        wishes[n] = [(at + i * skip) % size for i in range(size)]
        assert sorted(wishes[n]) == list(range(size))
    table, turn = {}, 0
    while len(table) < size:
        name = sorted(names)[turn % 3]
        table[next(s for s in wishes[name] if s not in table)] = name
        turn += 1
    assert sharding.fill([*names, "a"], size) == [table[s] for s in range(size)]


def test_a_shards_files_hold_its_rows(spark, tmp_path):
    # One key, and the null key, hold a third of all rows each.
    rows = [(i if i % 3 == 0 else 5 if i % 3 == 1 else None, f"t{i}" * 20) for i in range(600)]
    docs = docs_of(spark, rows).repartition(3)
    sharding.write(docs, str(tmp_path / "out"), ["a", "b", "c"], file_bytes=4_000)
    back = sharding.read(spark, str(tmp_path / "out"), docs.schema)
    got = sorted((r.doc_id or -1, r.text, r.slot, r.shard) for r in back.collect())
    assert got == sorted((r.doc_id or -1, r.text, r.slot, r.shard) for r in sharding.place(docs, ["a", "b", "c"]).collect())
    table, by_hash = sharding.fill(["a", "b", "c"]), docs.select("doc_id", (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(sharding.SIZE))).alias("s"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, table[r.s]) for r in by_hash.collect()}
    sizes = Counter(r.f for r in back.select(F.input_file_name().alias("f")).collect())
    assert len(sizes) > 8 and max(sizes.values()) < 150
    sharding.write(docs.limit(0), str(tmp_path / "none"), ["a"])


# ---- odd inputs


def operators(spark):
    machine = quality_fm.fit([], np.array([]))
    return {
        "spans": lambda d: spans.dedup(d),
        "imatch": lambda d: imatch.fingerprints(d),
        "licenses": lambda d: licenses.scan(d),
        "mixing": lambda d: mixing.mix(d),
        "bpe": lambda d: bpe.round_trip(d),
        "quality": lambda d: quality_fm.score(d, machine),
        "keep": lambda d: quality_fm.keep_good(d, machine),
        "langid": lambda d: langid.identify(d, langid.learn(d)),
        "ngram": lambda d: ngram_join.join(d),
        "one": lambda d: ngram_join.one_of_each(d),
        "sharding": lambda d: sharding.place(d),
    }


@pytest.mark.parametrize("name", ["spans", "imatch", "licenses", "mixing", "bpe", "quality", "keep", "langid", "ngram", "one", "sharding"])
def test_odd_and_empty_tables(spark, odd_docs, name):
    operator = operators(spark)[name]
    rows = operator(odd_docs).collect()
    assert operator(odd_docs.limit(0)).count() == 0
    if name not in ("mixing", "keep", "one"):
        assert len(rows) == odd_docs.count()
    if name == "one":
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 6, 6, 7, 8]
    if name == "ngram":
        assert {r.doc_id: r.component_id for r in rows}[5] == 4
        assert all(r.n_links == 0 for r in rows if r.doc_id in (1, 2, 3, 6, 7, None))


def test_vectors_of_an_empty_table(spark):
    assert near_vectors.near_duplicates(docs_of(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0
