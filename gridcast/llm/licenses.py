"""License notices by conditional compression.

Stretches of text around words that licenses use are compressed alone and with each template as a raw
zstandard dictionary.  Templates are ranked by how much they save; the best are confirmed by the exact
differences in wording, and what is confirmed is taken out before the stretch is tried again.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from gridcast.llm.store import slices

# Wording of short public license notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words of which every notice has one; a line may end between them, and the next begin with a comment sign.
CUES = r"(?i)licen[sc]e|copyright|permission[\W_]+is[\W_]+hereby|redistribut|public[\W_]+domain|free[\W_]+software|creative[\W_]+commons|\bcc0\b|\bcc[\W_]+by"
CUE = re.compile(CUES)
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
# In a text a line may end after the hyphen of a word, and the next begin with a comment sign.
BROKEN = re.compile(r"(?<=-)[^\S\n]{0,9}\n[\W_]{0,20}")
LOOSE = re.compile(r"[^\W_]+(?:(?:\.|-(?:[^\S\n]{0,9}\n[\W_]{0,20})?)[^\W_]+)*")
# Words that make another license of one; none may be missing or added.
TELLING = {"lesser", "affero", "nc", "sa", "by", "noncommercial", "attribution-noncommercial", "attribution-sharealike", "attribution", "by-nc", "by-sa"}
# Share of the template's words that must be found in order, and how many templates are confirmed by wording.
COVER, TRIED = 0.9, 6
# A stretch is cut into windows of so many words, half overlapping, as compression tells little on longer ones.
WINDOW = 400
# A notice has at most so many words: the longest template and a fifth more; so far a stretch reaches on both sides of a cue.
REACH = max(len(WORD.findall(t)) for texts in TEMPLATES.values() for t in texts) * 6 // 5 + 1


@lru_cache(maxsize=4)
def _prepared(level: int = 3) -> list[tuple[str, list[str], zstandard.ZstdCompressor, bytes]]:
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, WORD.findall(text.lower()), zstandard.ZstdCompressor(level=level, dict_data=raw), text.lower().encode()))
    return out


def reductions(block: str) -> list[tuple[float, int]]:
    """Templates by the bytes that they save as a dictionary, as a share of their own compressed size; best first."""
    data = block.lower().encode()
    plain = zstandard.ZstdCompressor(level=3)
    alone = len(plain.compress(data))
    ranked = []
    for at, (_, _, packer, text) in enumerate(_prepared()):
        saved = alone - len(packer.compress(data))
        ranked.append((saved / max(1, min(alone, len(plain.compress(text)))), at))
    return sorted(ranked, key=lambda x: (-x[0], x[1]))


def differences(template: list[str], words: list[str]) -> tuple[float, int, int, list[str], list[str]]:
    """Where a template best lies in a run of words: covered share, begin, end, words missing there, words added there."""
    core = difflib.SequenceMatcher(None, template, words, autojunk=False).find_longest_match()
    if not core.size:
        return 0.0, 0, 0, template, []
    # Words too far off to belong to it are left aside, as they could stand for some that do.
    slack = max(3, len(template) // 10)
    low = max(0, core.b - core.a - slack)
    match = difflib.SequenceMatcher(None, template, words[low : core.b - core.a + len(template) + slack], autojunk=False)
    blocks = [b._replace(b=b.b + low) for b in match.get_matching_blocks() if b.size]
    near = [b for b in blocks if abs((b.b - b.a) - (core.b - core.a)) <= slack]
    begin, end = near[0].b, near[-1].b + near[-1].size
    in_template = {i for b in near for i in range(b.a, b.a + b.size)}
    in_words = {i for b in near for i in range(b.b, b.b + b.size)}
    missing = [w for i, w in enumerate(template) if i not in in_template]
    added = [words[i] for i in range(begin, end) if i not in in_words]
    return len(in_template) / len(template), begin, end, missing, added


def _stretches(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """(begin, end) of the words around cues; what overlaps or touches is one stretch."""
    begin, end = 0, -1
    for cue in CUE.finditer(text):
        first, last = bisect_right(starts, cue.start()) - 1, bisect_left(starts, cue.end())
        low, high = max(0, first - REACH), min(len(starts), last + REACH)
        if low <= end:
            end = high
            continue
        if end > begin:
            yield begin, end
        begin, end = low, high
    if end > begin:
        yield begin, end


def _best(block: str, words: list[str]) -> tuple[tuple[str, float, float, str, str], int, int] | None:
    """The notice that covers most in a window, with the words where it begins and ends."""
    best = None
    present = set(words)
    ranked = [(share, at) for share, at in reductions(block) if share > 0]
    for rank, (share, at) in enumerate(ranked):
        if rank >= TRIED and best is not None:
            break
        name, template, _, _ = _prepared()[at]
        if sum(w in present for w in template) < COVER * len(template):
            continue
        cover, begin, end, missing, added = differences(template, words)
        # Numbers tell versions apart: none may be missing or other than the template's.
        figures = [w for w in missing if any(c.isdigit() for c in w)]
        telling = TELLING.intersection((*missing, *added))
        if cover >= COVER and not figures and not telling and len(added) <= len(template) // 5:
            key = (len(template) - 2 * len(missing) - len(added), share)
            if best is None or key > best[0]:
                best = (key, (name, round(share, 6), cover, " ".join(missing), " ".join(added)), begin, end)
    return best and best[1:]


def notices(text: str) -> list[tuple[str, float, float, str, str]]:
    """(license, saved, cover, missing, added) of each notice confirmed in a text, in order of place."""
    text = text.lower()
    if not CUE.search(text):
        return []
    places = [m.span() for m in LOOSE.finditer(text)]
    words = [BROKEN.sub("", text[a:b]) for a, b in places]
    starts = [a for a, _ in places]
    found: list[tuple[int, tuple[str, float, float, str, str]]] = []
    used: set[int] = set()
    for low, high in _stretches(text, starts):
        for at in range(low, max(low + 1, high - WINDOW // 2), WINDOW // 2):
            to = min(high, at + WINDOW)
            # What begins near the end of a window may go on after it; it is the next one's.
            limit = high if to == high else to - REACH
            left = [k for k in range(at, to) if k not in used]
            while left:
                block = "".join(words[k] + _gap(text, places, k) for k in left)
                if not CUE.search(block):
                    break
                best = _best(block, [words[k] for k in left])
                if best is None:
                    break
                notice, begin, end = best
                if left[begin] < limit:
                    found.append((left[begin], notice))
                    used.update(left[begin:end])
                # Each round takes words out, so that it ends.
                left = left[:begin] + left[end:]
    return [n for _, n in sorted(found, key=lambda x: x[0])]


def _gap(text: str, places: list[tuple[int, int]], at: int) -> str:
    """What stands between a word and the next; a line end and the comment signs around it are a blank."""
    gap = text[places[at][1] : places[at + 1][0] if at + 1 < len(places) else places[at][1] + 1]
    return " " if "\n" in gap or not gap else gap[:REACH]


NOTICE = StructType(
    [StructField("license", StringType()), StructField("saved", DoubleType()), StructField("cover", DoubleType()), StructField("missing", StringType()), StructField("added", StringType())]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses array, n_notices, notices) of every row: names in order, and each notice with its differences.

    Null and empty texts and texts without a cue have none.  Whole texts are read; only those with a cue
    leave the JVM.  Of templates that cover equally many words the one that saves more counts, then the
    first by name order of the list.  Rows are mapped one by one, so null ids, repeated rows, empty tables
    and other columns need no care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, counts, told = [], [], []
            for text in part.column(1).to_pylist():
                found = notices(text or "")
                names.append(sorted({n[0] for n in found}))
                counts.append(len(found))
                told.append([dict(zip(("license", "saved", "cover", "missing", "added"), n, strict=True)) for n in found])
            kind = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.float64()), ("cover", pa.float64()), ("missing", pa.string()), ("added", pa.string())]))
            arrays = [part.column(0), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(told, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "licenses", "n_notices", "notices"])

    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.when(text.rlike(CUES), text).alias("t"))
    schema = StructType(kept.schema.fields[:1]).add("licenses", ArrayType(StringType())).add("n_notices", "long").add("notices", ArrayType(NOTICE))
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
