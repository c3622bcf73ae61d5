"""Harmonic packing of token sequences (operator 9).

Lengths fall into reciprocal classes: a piece of length in (C/(k+1), C/k] is of class k,
and a bin of class k takes exactly k pieces, whatever their order. Each task fills its own
bins, so nothing is shuffled and no length is ever compared across tasks.

A document is first cut into whole sequences of C tokens. Its rest is cut at reciprocal
capacities floor(C / k), largest first, at most ``cuts`` times, so that pieces nearly fill
their share of a bin; what remains of them is a piece of its own class. Bins that a task
has not filled at its end are cut anew into whole sequences and, for the last of them,
sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.textops import distinct_words, text_slices, tokenize

CAPACITY, CUTS, END_ID = 2048, 3, 1
#: Words whose ids a worker remembers: those met since the last turn, and those of the turn before it.
CACHE_WORDS = 150_000
#: Bytes of text whose words are looked up together.
SLICE = 3_000_000
# The normaliser and the pre-token pattern for which texts may be cut into words.
_NORMAL = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: Punctuation that ends a pre-token of letters; an apostrophe may not.
_TRAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are one pre-token and that the normaliser leaves alone, once in lower case.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its white-space separated words in order, in any case of A-Z."""
    normal, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) if n["type"] == "Replace" else n["type"] for n in normal.get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    return steps == _NORMAL and splits == [_PATTERN] and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _WORD_END and not model.get("dropout")


class WordTokenizer:
    """Ids of whole texts by any tokenizer file.

    Where the file's rules let a text be cut at white space, distinct words are looked up once per slice, with
    a memory; else, and for texts with a special token's opening, texts go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.plain = Tokenizer.from_file(path)
        spec = json.loads(self.plain.to_str())
        self.by_word = _cuts_at_space(spec)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.by_word:
            self.opening = [t["content"][:2].encode() for t in spec["added_tokens"]]
            model = spec["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            # The same merges without the steps that plain words do not need.
            self.letters = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=_WORD_END))
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(_WORD_END)]] = True

    def _learn(self, missing: list[bytes]) -> None:
        """Ids of words in one call for all words of letters, and one for the others."""
        texts = [w.decode("utf-8", "surrogatepass").lower() for w in missing]
        plain = [bool(_LETTERS.fullmatch(t)) for t in texts]
        got = self.letters.encode_batch_fast(["\n".join(t for t, p in zip(texts, plain) if p)], add_special_tokens=False)[0]
        ids = np.array(got.ids, "<u4")
        edge = np.r_[0, np.flatnonzero(self.ends[ids]) + 1].tolist() if len(ids) else [0]
        own = [w for w, p in zip(missing, plain) if p]
        if len(edge) != len(own) + 1:
            raise ValueError("the tokenizer's words do not end as its file says")
        raw = ids.tobytes()
        self.known.update((w, raw[4 * s : 4 * e]) for w, s, e in zip(own, edge[:-1], edge[1:]))
        others = [w for w, p in zip(missing, plain) if not p]
        if others:
            texts = [w.decode("utf-8", "surrogatepass") for w in others]
            at = np.cumsum([0] + [len(t) + 1 for t in texts])
            got = self.plain.encode("\n".join(texts), add_special_tokens=False)
            raw = np.array(got.ids, "<u4").tobytes()
            # The offsets tell which word a token comes from.
            edge = np.searchsorted(np.array([s for s, _ in got.offsets], np.int64), at).tolist()
            self.known.update((w, raw[4 * s : 4 * e]) for w, s, e in zip(others, edge[:-1], edge[1:]))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Letters before trailing punctuation end a pre-token, so both parts stand alone."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        parts = []
        for w in words:
            core = w.rstrip(_TRAIL)
            # Beyond ASCII the last character may be punctuation that goes on.
            whole = len(core) == len(w) or not core or not (core[-1] < 128 and core[-1:].isalpha() or _LETTERS.fullmatch(core.decode("utf-8", "surrogatepass").lower()))
            parts.append((w, b"") if whole else (core, w[len(core) :]))
        known, older = self.known, self.older
        missing = []
        for w in {p for pair in parts for p in pair}:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                elif w:
                    missing.append(w)
        known[b""] = b""
        if missing:
            self._learn(missing)
        return [known[core] + known[rest] if rest else known[core] for core, rest in parts]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            for got in self.plain.encode_batch([t or "" for t in texts], add_special_tokens=False):
                yield np.array(got.ids, "<u4").tobytes()
            return
        found = tokenize(texts, lower=True)
        first, of = distinct_words(found)
        ids = self._ids_of([found.raw[s:e] for s, e in zip(found.starts[first].tolist(), found.ends[first].tolist())])
        size = np.array([len(i) >> 2 for i in ids], np.int64)
        start = np.cumsum(size) - size
        n = size[of]
        end = np.cumsum(n)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[of] - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        edge = np.r_[0, end][found.bounds].tolist()
        for t, s, e in zip(texts, edge[:-1], edge[1:]):
            special = t and any(o in t.encode("utf-8", "surrogatepass") for o in self.opening) if self.opening and "<" in (t or "") else False
            yield np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if special else flat[s:e].tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(length: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then reciprocal shares, then the rest."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    for _ in range(cuts):
        if not rest:
            break
        share = capacity // -(-capacity // rest)
        pieces.append(share)
        rest -= share
    return pieces + [rest] * bool(rest)


class _Bins:
    """One task's open bins; ``put`` and ``end`` return finished sequences as lists of (doc, start, length, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def put(self, doc: int, start: int, length: int) -> list | None:
        k = self.capacity // length
        if k == 1:
            return [(doc, start, length, 0)]
        pieces = self.open.setdefault(k, [])
        pieces.append((doc, start, length, pieces[-1][3] + pieces[-1][2] if pieces else 0))
        return self.open.pop(k) if len(pieces) == k else None

    def end(self) -> Iterator[list]:
        pieces = [p[:3] for k in sorted(self.open) for p in self.open[k]]
        left, self.open = sum(p[2] for p in pieces), {}
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            out, offset = [], 0
            while offset < room:
                doc, start, length = pieces.pop(0)
                take = min(length, room - offset)
                out.append((doc, start, take, offset))
                offset += take
                if take < length:
                    pieces.insert(0, (doc, start + take, length - take))
            yield out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, cuts: int = CUTS, with_ids: bool = False) -> DataFrame:
    """Cut tokenised documents into pieces and pieces into sequences of at most ``capacity`` tokens.

    docs: doc_id, text. A document is its ids and an end id (null or blank text: the end id alone). Returns one
    row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]. Each input row is a
    document of its own, repeated or null doc_ids too. capacity must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        bins, count = _Bins(capacity), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # documents with pieces in open bins: id, ids, pieces to come
        rows: list[tuple] = []

        def close(sequence):
            nonlocal count
            for doc, start, length, offset in sequence:
                doc_id, ids, n, _ = held[doc]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), n, count, offset, part)[: 7 + with_ids])
                held[doc][3] -= length
                if not held[doc][3]:
                    del held[doc]
            count += 1

        def flush():
            out = [pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in fields.split(", ")])

        doc = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in text_slices(texts, SLICE):
                for doc_id, raw in zip(ids[s:e], words.ids(texts[s:e])):
                    raw += END_ID.to_bytes(4, "little")
                    n = len(raw) // 4
                    held[doc] = [doc_id, raw, n, n]
                    start = 0
                    for length in cut(n, capacity, cuts):
                        done = bins.put(doc, start, length)
                        if done:
                            close(done)
                        start += length
                    doc += 1
                if rows:
                    yield flush()
        for sequence in bins.end():
            close(sequence)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, fields)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
