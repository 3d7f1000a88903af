"""Token ids of a whole corpus with a public byte-level BPE (problem 7).

Method: content-defined chunk reuse. A rolling hash over the characters cuts every text at places
that depend only on the nearby content, so that equal passages in different documents give equal
chunks. Every distinct chunk is encoded once. A chunk is kept as three parts: the text before its
first safe place, the ids between its first and last safe places, and the text after the last one;
at a safe place (something that is not white space, then white space) the tokenizer's own splitting
has a border whatever stands around it. The join of two chunks is repaired by re-encoding from the
last safe place of the one to the first safe place of the next; a chunk without a safe place lends
its whole text to the repair, so that the window grows until both sides agree. The result equals
encoding of the whole text, exactly.

The heavy steps are a map-side combined distinct, a join on the chunk, and a regrouping by document.
A chunk that very many documents share makes its join partition large; adaptive execution splits
such partitions. Whole repeated texts are encoded once as well.

Defined cases: null and empty texts give an empty list; white space and control characters are kept;
strings that look like special tokens are ordinary text; repeated rows repeat their ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
WINDOW = 16
MASK_BITS = 8
_GEAR = np.random.default_rng(20_240_607).integers(1, 2**32, size=4096, dtype=np.uint64)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def cuts(text: str, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of a text: a rolling hash of the last WINDOW characters decides, nothing else."""
    n = len(text)
    if n <= 2 * WINDOW:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    values = _GEAR[codes & 4095] ^ (codes.astype(np.uint64) >> np.uint64(12))
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += values[k : n - WINDOW + 1 + k] << np.uint64(k)
    places = np.flatnonzero((rolled >> np.uint64(12)) & np.uint64((1 << bits) - 1) == 0) + WINDOW
    ends = places.tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def safe_places(text: str) -> tuple[int, int] | None:
    """The first and last i with a character that is no white space before i and white space at i."""
    first = last = None
    for i in range(1, len(text)):
        if text[i].isspace() and not text[i - 1].isspace() and text[i] in " \t\n\r":
            first = i
            break
    if first is None:
        return None
    for i in range(len(text) - 1, 0, -1):
        if text[i] in " \t\n\r" and not text[i - 1].isspace():
            last = i
            break
    return first, last


def encode_parts(texts: list[str], path: str) -> list[tuple[str, list[int] | None, str]]:
    """(head, ids, tail) of each chunk; ids is None where the chunk has no safe place and head is all of it."""
    places = [safe_places(t) for t in texts]
    bodies = [t[p[0] : p[1]] if p else "" for t, p in zip(texts, places, strict=True)]
    ids = [e.ids for e in tokenizer(path).encode_batch(bodies, add_special_tokens=False)]
    return [(t[: p[0]], i, t[p[1] :]) if p else (t, None, "") for t, p, i in zip(texts, places, ids, strict=True)]


def assemble(parts: list[list[tuple[str, list[int] | None, str]]], path: str) -> list[list[int]]:
    """The ids of each document from the parts of its chunks in order; all repairs of the batch are encoded together."""
    windows: list[str] = []
    plans: list[list[tuple[bool, object]]] = []
    for chunks in parts:
        plan, open_text = [], ""
        for head, ids, tail in chunks:
            open_text += head
            if ids is not None:
                if open_text:
                    plan.append((True, len(windows)))
                    windows.append(open_text)
                plan.append((False, ids))
                open_text = tail
        if open_text:
            plan.append((True, len(windows)))
            windows.append(open_text)
        plans.append(plan)
    repaired = [e.ids for e in tokenizer(path).encode_batch(windows, add_special_tokens=False)]
    return [[x for repair, p in plan for x in (repaired[p] if repair else p)] for plan in plans]


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, positions, chunks = [], [], []
        for key, text in zip(batch["text_key"], batch["text"], strict=True):
            start = 0
            for k, end in enumerate(cuts(text)):
                keys.append(key)
                positions.append(k)
                chunks.append(text[start:end])
                start = end
        yield pd.DataFrame({"text_key": keys, "position": np.array(positions, dtype=np.int32), "chunk": chunks})


def encode(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text) -> (doc_id, ids)."""
    keyed = documents.select("doc_id", F.sha2("text", 256).alias("text_key"), "text")
    filled = keyed.where(F.length("text") > 0)
    distinct = filled.select("text_key", "text").distinct()
    chunks = distinct.mapInPandas(_chunked, "text_key string, position int, chunk string")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = encode_parts(list(batch["chunk"]), path)
            yield pd.DataFrame({"chunk": batch["chunk"], "head": [p[0] for p in parts], "body": [p[1] for p in parts], "tail": [p[2] for p in parts]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[(p["head"], None if p["body"] is None else list(p["body"]), p["tail"]) for p in sorted(ps, key=lambda p: p["position"])] for ps in batch["parts"]]
            yield pd.DataFrame({"text_key": batch["text_key"], "ids": assemble(parts, path)})

    dictionary = chunks.select("chunk").distinct().mapInPandas(encoded, "chunk string, head string, body array<int>, tail string")
    by_text = chunks.join(dictionary, "chunk").groupBy("text_key").agg(F.collect_list(F.struct("position", "head", "body", "tail")).alias("parts"))
    ids = by_text.mapInPandas(joined, "text_key string, ids array<int>")
    blank = keyed.where("text is null or length(text) = 0").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return filled.select("doc_id", "text_key").join(ids, "text_key").select("doc_id", "ids").unionByName(blank)


def encode_plain(texts: list[str | None], path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> list[list[int]]:
    """The ids of whole texts without chunks: what ``encode`` must equal, for tests."""
    return [e.ids for e in tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
