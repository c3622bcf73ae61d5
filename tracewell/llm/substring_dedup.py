"""Substring dedup with difference-cover anchors (operator 2).

A cover D modulo v holds, for any two positions i and j, a shift d < v with both
(i + d) mod v and (j + d) mod v in D. Two equal runs of ``window`` words therefore
share an anchor of ``window - v + 1`` words that starts at a cover position in both
documents. Only cover positions are hashed; where an anchor is shared by two
documents, the windows around it are hashed whole (96 bits, so that among 10^13
windows a chance of one in a thousand is left that any two different ones agree) and the
smallest doc_id of each window is found. Both exchanges first merge entries inside a task,
so a passage that a third of all documents hold moves once per task, not once per
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import batches_of, bucket_count, bucketed_rows, pack, packed_schema, rows_of, runs, text_bytes, unpack
from tracewell.llm.textops import Words, gram_hashes, text_slices, tokenize

_U, _I = np.uint64, np.int64


def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues that covers every difference modulo ``period`` (greedy)."""
    cover: list[int] = [0]
    while len(have := {(a - b) % period for a in cover for b in cover}) < period:
        cover.append(max(range(period), key=lambda x: (len({d for c in cover for d in ((x - c) % period, (c - x) % period)} - have), -x)))
    return tuple(sorted(cover))


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return docs % buckets


def _settle_local(h: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by hash, then doc, and for each in that order whether its hash is new."""
    order = np.lexsort((doc, *h[::-1]))
    sorted_h = [x[order] for x in h]
    first = np.zeros(len(order), bool)
    if len(order):
        first[0] = True
        for x in sorted_h:
            first[1:] |= x[1:] != x[:-1]
    return order, first


def _version(text: Words, i: int) -> int:
    """Tells texts of one doc_id apart."""
    own = text.hashes[text.bounds[i] : text.bounds[i + 1]]
    return int((own * (np.arange(len(own), dtype=_U) * _U(2) + _U(1))).sum(dtype=_U).astype(_I))


def _nothing(*columns: str) -> pa.Table:
    return pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in columns)]).empty_table()


def remove_repeated_windows(docs: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller doc_id.

    docs: doc_id, text (more columns are ignored). Returns doc_id, n_words, n_removed, kept_text
    (kept words joined by one space), one row per input row, windows judged on the input.
    Null or blank text: no words, empty kept_text. Null doc_id: compared with nothing, kept whole.
    Repeated doc_id: its rows are one document, so neither removes words of the other.
    """
    anchor = window - period + 1
    if anchor < 1 or period < 1:
        raise ValueError("period must be from 1 to the window length")
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_words = text_bytes(docs) / 6
    buckets = bucket_count(n_words * cover.mean())
    doc_buckets = bucket_count(n_words / 2)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in text_slices(texts):
                yield from batches_of(_anchors_of(ids[s:e], texts[s:e]))

    def _anchors_of(ids, texts):
        found = tokenize([t if i is not None else None for i, t in zip(ids, texts)])
        place = np.arange(len(found.hashes)) - np.repeat(found.bounds[:-1], np.diff(found.bounds))
        whole = np.repeat(np.diff(found.bounds) >= window, np.diff(found.bounds))
        at = np.flatnonzero(cover[place % period] & whole & (found.room() >= anchor))
        if not len(at):
            return
        h, pos = gram_hashes(found.hashes, anchor)[at], place[at].astype(np.int32)
        doc = np.array([i or 0 for i in ids], _I)[found.owners()[at]]
        order, first = _settle_local([h], doc)
        run = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        last = np.r_[start[1:], len(h)] - 1
        many = doc[order[start]] != doc[order[last]]  # shared inside this slice already
        # One entry stands for all documents of a locally shared anchor; the flag says that it needs no answer.
        shared, send = np.empty(len(h), bool), np.empty(len(h), bool)
        shared[order] = many[run]
        send[order] = ~many[run] | first
        yield pack((h[send] % _U(buckets)).astype(_I), {"h": h[send], "doc": doc[send], "pos": pos[send], "flag": shared[send].astype(np.int8)})
        # Settled answers ride along in buckets chosen by document.
        yield pack(_doc_bucket(doc[shared], buckets), {"h": np.empty((shared.sum(), 0), _U), "doc": doc[shared], "pos": pos[shared], "flag": np.full(shared.sum(), 2, np.int8)})

    def shared_anchors(table: pa.Table) -> pa.Table:
        flag, doc, pos = unpack(table, "flag", np.int8), unpack(table, "doc", _I), unpack(table, "pos", np.int32)
        settled = flag == 2
        h = unpack(table, "h", _U)
        d, p, f = doc[~settled], pos[~settled], flag[~settled]
        order = np.lexsort((d, h))
        h, d, p, f = h[order], d[order], p[order], f[order]
        start, run = runs(h)
        shared = np.zeros(len(start), bool)
        if len(start):
            last = np.r_[start[1:], len(h)] - 1
            shared = (d[start] != d[last]) | (np.maximum.reduceat(f, start) == 1)
        answer = shared[run] & (f == 0) if len(h) else np.zeros(0, bool)
        doc, pos = np.r_[doc[settled], d[answer]], np.r_[pos[settled], p[answer]]
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        out = pack(_doc_bucket(doc, doc_buckets), {"doc": doc, "pos": pos})
        return pa.Table.from_batches([out]) if out else _nothing("doc", "pos")

    def windows(blobs: pa.Table, right: pa.Table) -> pa.Table:
        left = rows_of(blobs) if right.num_rows else None
        if left is None:
            return _nothing("h1", "h2", "doc", "pos", "ver", "flag")
        doc, pos = unpack(right, "doc", _I), unpack(right, "pos", np.int32)
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        found = []
        all_ids, all_texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        told = np.unique(doc)
        rows = [r for r, i in enumerate(all_ids) if i is not None and len(told) and told[min(np.searchsorted(told, i), len(told) - 1)] == i]
        for s, e in text_slices([all_texts[r] for r in rows], 32_000_000):
            ids = np.array([all_ids[r] for r in rows[s:e]], _I)
            text = tokenize([all_texts[r] for r in rows[s:e]])
            # Window w holds the anchors that start at w .. w + period - 1.
            hit = np.zeros(len(text.hashes) + 1, _I)
            for i, b0, b1 in zip(ids.tolist(), text.bounds[:-1].tolist(), text.bounds[1:].tolist()):
                f, t = np.searchsorted(doc, [i, i + 1])
                at = pos[f:t][pos[f:t] < b1 - b0]
                np.add.at(hit, b0 + np.maximum(at - (period - 1), 0), 1)
                np.add.at(hit, b0 + at + 1, -1)
            at = np.flatnonzero((np.cumsum(hit[:-1]) > 0) & (text.room() >= window))
            if not len(at):
                continue
            h1, h2 = gram_hashes(text.hashes, window, 1)[at], gram_hashes(text.hashes, window, 2)[at]
            h2 = (h2 >> _U(32)).astype(np.uint32)
            owner = text.owners()[at]
            d, p, v = ids[owner], (at - text.bounds[owner]).astype(np.int32), np.array([_version(text, r) for r in range(e - s)], _I)[owner]
            order, first = _settle_local([h1, h2], d)
            # Late here: a smaller document of this group has the window. A document may hold a window more than once.
            late = np.empty(len(d), bool)
            late[order] = d[order] > d[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            for part, flag in ((~late, 0), (late, 2)):
                where = _doc_bucket(d[part], buckets) if flag else (h1[part] % _U(buckets)).astype(_I)
                n = part.sum()
                found.append(pack(where, {"h1": h1[part] if not flag else np.empty((n, 0), _U), "h2": h2[part] if not flag else np.empty((n, 0), np.uint32), "doc": d[part], "pos": p[part], "ver": v[part], "flag": np.full(n, flag, np.int8)}))
        found = list(batches_of(found))
        return pa.Table.from_batches(found) if found else _nothing("h1", "h2", "doc", "pos", "ver", "flag")

    def late_windows(table: pa.Table) -> pa.Table:
        x1, x2 = unpack(table, "h1", _U), unpack(table, "h2", np.uint32)
        d, p, v, f = unpack(table, "doc", _I), unpack(table, "pos", np.int32), unpack(table, "ver", _I), unpack(table, "flag", np.int8)
        ask = np.flatnonzero(f == 0)
        order, first = _settle_local([x1, x2], d[ask])
        gone = f == 2
        if len(ask):
            sorted_d = d[ask][order]
            gone[ask[order]] = sorted_d > sorted_d[np.flatnonzero(first)][np.cumsum(first) - 1]
        doc, pos, ver = d[gone], p[gone], v[gone]
        order = np.lexsort((pos, doc))
        out = pack(_doc_bucket(doc[order], doc_buckets), {"doc": doc[order], "pos": pos[order], "ver": ver[order]})
        return pa.Table.from_batches([out]) if out else _nothing("doc", "pos", "ver")

    def kept(blobs: pa.Table, right: pa.Table) -> pa.Table:
        left = rows_of(blobs)
        if left is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        doc, pos, ver = unpack(right, "doc", _I), unpack(right, "pos", np.int32), unpack(right, "ver", _I)
        order = np.argsort(doc, kind="stable")
        doc, pos, ver = doc[order], pos[order], ver[order]
        ids, all_texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        n, removed, texts = [], [], []
        for s, e in text_slices(all_texts, 32_000_000):
            text = tokenize(all_texts[s:e])
            gone = np.zeros(len(text.hashes) + 1, _I)
            for r, (i, b0) in enumerate(zip(ids[s:e], text.bounds[:-1].tolist())):
                f, t = np.searchsorted(doc, [i, i + 1]) if i is not None else (0, 0)
                if f < t:
                    at = pos[f:t][ver[f:t] == _version(text, r)] + b0  # rows that repeat a doc_id may differ
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
            out = np.cumsum(gone[:-1]) > 0
            for r, (b0, b1) in enumerate(zip(text.bounds[:-1].tolist(), text.bounds[1:].tolist())):
                x = int(out[b0:b1].sum())
                n.append(b1 - b0)
                removed.append(x)
                if not x:
                    texts.append(b" ".join((all_texts[s + r] or "").encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass"))
                else:
                    left_words = np.flatnonzero(~out[b0:b1]) + b0
                    texts.append(b" ".join([text.raw[u:v] for u, v in zip(text.starts[left_words].tolist(), text.ends[left_words].tolist())]).decode("utf-8", "surrogatepass"))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    by_doc = bucketed_rows(docs, doc_buckets)
    near = docs.mapInArrow(anchors, packed_schema("h", "doc", "pos", "flag")).groupBy("bucket").applyInArrow(shared_anchors, packed_schema("doc", "pos"))
    asked = by_doc.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInArrow(windows, packed_schema("h1", "h2", "doc", "pos", "ver", "flag"))
    late = asked.groupBy("bucket").applyInArrow(late_windows, packed_schema("doc", "pos", "ver"))
    return by_doc.groupBy("bucket").cogroup(late.groupBy("bucket")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
