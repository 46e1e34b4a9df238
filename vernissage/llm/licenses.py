"""License scans: base phrases, and templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw

# The phrases every caller can rely on, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Mandatory words stand plainly; [[ ]] is optional and may be nested; {n} stands for up to n words of any kind.
# Texts are compared as lower-case words, so punctuation and layout do not matter.
TEMPLATES = {
    "mit-notice": "released under [[the terms of]] the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution [[[[3]] neither the name of {12} nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission]]",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held "
    "liable for any damages arising from the use of this software",
    "apache-2.0-notice": "licensed under the apache license [[version]] 2 0 [[the license [[you may not use this file except in "
    "compliance with the license]]]]",
    "gpl-notice": "[[this {3} is]] licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license "
    "[[as published by the free software foundation]] [[either]] version {1} [[of the license]] [[or at your option any later version]]",
    "gpl-text": "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general "
    "public license as published by the free software foundation [[either]] version {1} of the license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    "cc0-1.0-notice": "[[licensed under]] [[creative commons]] cc0 1 0 [[universal]]",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",
    "cc-by-nc-sa-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc sa 4 0",
    "cc-by-nd-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nd 4 0",
}
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SLICE_BYTES = 1 << 22


@dataclass(frozen=True)
class Automaton:
    """Positions are the words of a template; bit k of a set stands for position k.

    `after[k]` has the positions that may come next behind k, `start` those that
    may come first, `final` those that may come last, `words` the positions of a
    word, `any_` those of replaceable words.
    """

    start: int
    final: int
    after: tuple[int, ...]
    words: dict[bytes, int]
    any_: int
    anchor: bytes

    def longest(self, tokens: list[bytes], at: int) -> int:
        """Words of the longest match that begins at `at`, 0 if none."""
        live, best = self.start, 0
        for n in range(at, len(tokens)):
            live &= self.words.get(tokens[n], 0) | self.any_
            if not live:
                break
            if live & self.final:
                best = n - at + 1
            following = 0
            while live:
                low = live & -live
                following |= self.after[low.bit_length() - 1]
                live ^= low
            live = following
        return best


def compile_template(template: str) -> Automaton:
    """Builds the automaton; a template needs a mandatory word and may not begin with a replaceable one."""
    parts = re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template)
    words: dict[bytes, int] = {}
    after: list[int] = []
    mandatory: list[bytes] = []
    any_ = 0
    start = 0
    ends, can_be_first = 0, True  # positions that may stand just before the next part; whether none may
    stack: list[tuple[int, bool]] = []

    def add(optional_bit: bool) -> int:
        nonlocal ends, can_be_first, start
        bit = 1 << len(after)
        after.append(0)
        for k in range(len(after) - 1):
            if ends >> k & 1:
                after[k] |= bit
        if can_be_first:
            start |= bit
        if optional_bit:
            ends |= bit
        else:
            ends, can_be_first = bit, False
        return bit

    for part in parts:
        if part == "[[":
            stack.append((ends, can_be_first))
        elif part == "]]":
            before, first = stack.pop()
            ends, can_be_first = ends | before, can_be_first or first
        elif part[0] == "{":
            for _ in range(int(part[1:-1])):
                any_ |= add(True)
        else:
            word = part.lower().encode()
            words[word] = words.get(word, 0) | add(False)
            if not stack:
                mandatory.append(word)
    if stack or not mandatory or start & any_:
        raise ValueError("a template needs closed regions, a mandatory word and a plain word first")
    return Automaton(start, ends, tuple(after), words, any_, max(mandatory, key=len))


def scan_words(tokens: list[bytes], base: dict[tuple[bytes, ...], str], automata: dict[str, Automaton]):
    """(base starts, base labels, all labels, words covered) of one text."""
    starts, base_labels, labels = [], set(), set()
    covered = np.zeros(len(tokens), dtype=bool)
    where: dict[bytes, list[int]] = {}
    for n, token in enumerate(tokens):
        where.setdefault(token, []).append(n)
    for phrase, label in base.items():
        for n in where.get(phrase[0], ()):
            if tuple(tokens[n : n + len(phrase)]) == phrase:
                starts.append(n)
                base_labels.add(label)
                covered[n : n + len(phrase)] = True
    for label, automaton in automata.items():
        if automaton.anchor not in where:
            continue
        for word, bits in automaton.words.items():
            if bits & automaton.start:
                for n in where.get(word, ()):
                    length = automaton.longest(tokens, n)
                    if length:
                        labels.add(label)
                        covered[n : n + length] = True
    return starts, base_labels, base_labels | labels, int(covered.sum())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of `docs`.

    A template label is given where some run of words of the text passes the
    template's automaton, that is, all mandatory words stand there in order with
    nothing between but optional wording and replaceable words. `score` is the
    share of the text's words inside a base phrase or a template match.

    Texts are read whole; one that holds no last word of a base phrase and no
    longest mandatory word of a template can match nothing and is only counted.
    Null and empty texts have no words, no labels and score 0. Repeated rows are
    scanned each, other columns are ignored, an empty table gives no rows.
    """
    phrases = {tuple(p.encode() for p in phrase.split()): label for phrase, label in base.items()}
    automata = {label: compile_template(t) for label, t in templates.items()}
    hints = re.compile(b"|".join(sorted({re.escape(w) for w in [*(p[-1] for p in phrases), *(a.anchor for a in automata.values())]})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in bw.slices(batch.column(1), _SLICE_BYTES):
                data, offsets = bw.text_bytes(batch.column(1).slice(a, b - a))
                lower = data.tobytes().translate(_LOWER)
                counts = np.diff(bw.word_spans(np.frombuffer(lower, dtype=np.uint8), offsets, bw.NOT_ALNUM_BYTES)[2])
                for n in range(b - a):
                    own = lower[offsets[n] : offsets[n + 1]]
                    total = int(counts[n])
                    if not hints.search(own):
                        rows.append((total, 0, None, None, "", "", 0.0))
                        continue
                    starts, known, labels, covered = scan_words(_WORD.findall(own), phrases, automata)
                    rows.append((total, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(known)), ",".join(sorted(labels)), covered / total if total else 0.0))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    form = f"k {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return rows.mapInArrow(run, form).withColumnRenamed("k", key)
