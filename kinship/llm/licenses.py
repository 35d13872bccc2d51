"""Operator 1: license scans as an exact set-similarity join of text blocks with templates.

Words are runs of letters, digits and all beyond ASCII, lower-cased over A-Z. A template is a phrase, a sentence of a
notice or a whole license text; a block is a window
of consecutive words, of a width and stride that depend on the template's size class, so that as many consecutive words
as a template has always lie in one block. A block meets a template if it holds at least CONTAINMENT of the template's
distinct words. Tokens are ordered by their frequency in the whole corpus, rarest first; then
  prefix:     n - ceil(c n) + 1 first tokens of a template suffice to find every block that can meet it,
  length:     a block of fewer distinct template tokens than ceil(c n) can't,
  positional: nor one whose tokens after a common one can't make up what is missing.
What passes is verified by merging the two ordered sets. Tokens of no template can't be common, so that blocks are kept
without them. Each found block is then searched for the places where the phrase's words stand consecutively.

Templates are a parameter of a few hundred rows at most and go to every task; text is read where it lies and not shuffled.
Null texts count as empty; ids may repeat, each row gives a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm.common import WORD_BYTES, small_batches, texts
from kinship.llm.license_texts import TEXTS

CONTAINMENT = 0.8
#: (phrase, label): those whose places are counted.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: (phrase, label): sentences of notices, found by containment only, as are the whole texts.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    counted: bool

    @property
    def span(self) -> int:
        """Words of a block for this template: twice its size as a power of two, so that half a block holds it."""
        return 2 << max(1, (len(self.words) - 1).bit_length())


def templates(counted=BASE, noticed=NOTICES + TEXTS) -> list[Template]:
    return [Template(tuple(p.encode().translate(WORD_BYTES).split()), label, base) for rows, base in ((counted, True), (noticed, False)) for p, label in rows]


def frequencies(docs: DataFrame, known: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in the corpus: as many rows as the templates have words."""
    vocabulary = {w for t in known for w in t.words}

    def count(batches):
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in texts(batch, text_col):
                for w in vocabulary.intersection(words := text.translate(WORD_BYTES).split()):
                    total[w] += words.count(w) if len(words) < 1000 else 0
                if len(words) >= 1000:
                    for w in words:
                        if w in total:
                            total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(text_col).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(w): n for w, n in rows}


class Join:
    """The templates' side of the join: an index from prefix tokens to templates."""

    def __init__(self, known: list[Template], frequency: dict[bytes, int], containment: float = CONTAINMENT):
        self.known = known
        self.rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in known]
        self.need = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (tokens, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for at, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.index.setdefault(token, []).append((t, at))
        self.prefix = frozenset(w for w, r in self.rank.items() if r in self.index)

    def overlap(self, t: int, block: list[int], i: int, j: int) -> int:
        """Common tokens of template t from its i-th and a block from its j-th, as far as they can still suffice."""
        tokens, need, found = self.sets[t], self.need[t], 0
        while i < len(tokens) and j < len(block):
            if found + min(len(tokens) - i, len(block) - j) < need:
                return found
            if tokens[i] == block[j]:
                found, i, j = found + 1, i + 1, j + 1
            elif tokens[i] < block[j]:
                i += 1
            else:
                j += 1
        return found

    def blocks(self, words: list[bytes]):
        """(template, block's first word, words of the block, common share) of every block that meets a template."""
        if self.prefix.isdisjoint(words):
            return
        hits = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]
        by_block: dict[tuple[int, int], set[int]] = {}
        wanted = {}
        for i, r in hits:
            for t, _ in self.index.get(r, ()):
                span = self.known[t].span
                for b in (i // (span // 2) - 1, i // (span // 2)):
                    if b >= 0 or i < span // 2:
                        wanted.setdefault((span, max(b, 0)), set()).add(t)
        for i, r in hits:
            for span in {s for s, _ in wanted}:
                for b in {max(0, i // (span // 2) - 1), i // (span // 2)}:
                    if (span, b) in wanted:
                        by_block.setdefault((span, b), set()).add(r)
        for (span, b), tokens in by_block.items():
            block = sorted(tokens)
            seen = set()
            for j, token in enumerate(block):
                for t, i in self.index.get(token, ()):
                    if t in seen or t not in wanted[span, b]:
                        continue
                    seen.add(t)  # j is the first common prefix token: earlier ones aren't common
                    if len(block) < self.need[t] or 1 + min(len(self.sets[t]) - i - 1, len(block) - j - 1) < self.need[t]:
                        continue
                    if (common := self.overlap(t, block, i, j)) >= self.need[t]:
                        yield t, b * (span // 2), span, common / len(self.sets[t])

    def scan(self, text: bytes) -> tuple[int, dict[tuple[int, int], None], set[str], float]:
        """Words of a text, its (template, first word) places of counted phrases, the labels met and the largest share."""
        words, places, labels, best = text.translate(WORD_BYTES).split(), {}, set(), 0.0
        for t, start, span, share in self.blocks(words):
            template = self.known[t]
            labels.add(template.label)
            best = max(best, share)
            if template.counted:
                n = len(template.words)
                for k in range(start, min(start + span, len(words)) - n + 1):
                    if words[k] == template.words[0] and tuple(words[k : k + n]) == template.words:
                        places[t, k] = None
        return len(words), places, labels, best


def scan(docs: DataFrame, known: list[Template] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, places (phrase, first word), labels (distinct, sorted) and score, the largest share met."""
    docs = small_batches(docs)
    known = known if known is not None else templates()
    join = Join(known, frequencies(docs, known, text_col), containment)
    shared = docs.sparkSession.sparkContext.broadcast(join)  # the templates' words
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))

    def run(batches):
        join = shared.value
        for batch in batches:
            n, places, labels, score = [], [], [], []
            for text in texts(batch, text_col):
                count, found, met, best = join.scan(text)
                n.append(count)
                places.append([{"label": join.known[t].label, "word": k} for t, k in sorted(found, key=lambda x: (x[1], x[0]))])
                labels.append(sorted(met))
                score.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())], names=[id_col, "n_words", "places", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<struct<label:string,word:long>>, labels array<string>, score double")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_distinct(F.col("places.label")))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"), F.array_join(labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, "labels")), ",").alias("labels"), "score")
