"""Benchmark decontamination by latent semantic retrieval (operator 10).

1. Words are dealt over ``DIMS`` dimensions by hash; their rarity is counted over all documents.
2. The latent space is that of all passages of the documents (``WINDOW`` words, half overlapping) and of the
   benchmark's items: a randomised SVD (a Gaussian sketch, multiplied ``POWER`` times by the passages' Gram matrix, each
   time one distributed pass over every passage, then Nystrom's approximation from the last product) of their TF-IDF
   vectors. No passage is left out: texts are cut into words once and kept as 16-bit dimensions.
3. Windows somewhat longer than an item slide over every document. In the latent space, with directions weighed by
   their singular values so that common ones count little, a window is a candidate for an item if their cosine
   reaches ``COVER`` of that of the item among as many other words. So the gate asks for a share of the item
   (or of words that keep company with its own) and does not tighten as the corpus grows.
4. A candidate is confirmed by the longest common subsequence of the window (half an item wider on both sides) and
   the item: a share of ``LCS`` of the item's words, or of ``LCS_ANSWER`` if the item's answer (its last words) is
   there too, all within twice the item's words.

Each document is judged by its own text and by models of fixed size, so the search needs no shuffle. Items go in
blocks of ``ITEM_BLOCK`` parts, a pass over the documents each; what reaches every task has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import keep, tree_sum
from tracewell.llm.textops import hash_spans, text_slices, word_spans, words

_U, _I = np.uint64, np.int64
WINDOW, ITEM_WORDS, ITEM_BLOCK = 32, 64, 16_384
DIMS, RANK, OVERSAMPLE, POWER = 1 << 14, 128, 16, 2
COVER, LCS, LCS_ANSWER, ANSWER = 0.45, 0.7, 0.5, 0.2
#: Dimensions whose sums travel as one value (147 kB at RANK), and tasks that add them up: what each sends stays under spark.task.maxDirectResultSize.
SLICE, SUM_TASKS = 256, 16
#: Words of half a passage; halves that are worked on together; words for each task of a pass (tasks at least).
HALF, HALVES, TASK_WORDS, TASKS = WINDOW // 2, 8192, 1 << 26, 12
#: Bytes of text whose words are kept as one row.
KEEP_BYTES = 2_000_000
#: Words of a block; windows are made of whole blocks.
BLOCK = 8
#: For items of up to so many words: blocks of a window, and of a step between windows.
CLASSES = {8: (2, 1), 16: (3, 1), 24: (4, 1), 32: (6, 2), 48: (8, 2), 64: (12, 4)}
#: Bytes of text that are searched together.
SEARCH_BYTES = 500_000
#: Windows that meet the items at a time, and products that are held.
_WINDOWS, _CELLS = 2048, 1 << 20
_EDGE = b".,;:!?\"'()[]|*#$%&"


def _clean(ws: list[bytes]) -> list[bytes]:
    return [c for w in ws if (c := w.strip(_EDGE))]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel over b)."""
    at: dict = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        m = at.get(w, 0)
        u = row & m
        row = (row + u) | (row - u)
        row &= full
    return len(b) - row.bit_count()


def _stripped(texts: list[str | None]):
    """Words of texts without punctuation at their edges: raw bytes, starts, ends, hashes, bounds."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts).lower()
    starts, ends = word_spans(joined)
    text_starts = np.cumsum(np.r_[0, np.array([len(p) + 1 for p in parts], _I)])
    owned = np.searchsorted(starts, text_starts)
    raw = np.frombuffer(joined, np.uint8)
    edge = np.zeros(256, bool)
    edge[list(_EDGE)] = True
    live = np.flatnonzero(edge[raw[starts]])
    while len(live):
        starts[live] += 1
        live = live[starts[live] < ends[live]]
        live = live[edge[raw[starts[live]]]]
    live = np.flatnonzero((starts < ends) & edge[raw[ends - 1]])
    while len(live):
        ends[live] -= 1
        live = live[edge[raw[ends[live] - 1]]]  # stops at the latest before the word's first letter
    real = np.flatnonzero(starts < ends)
    bounds = np.searchsorted(real, owned)
    starts, ends = starts[real], ends[real]
    return joined, starts, ends, hash_spans(joined, starts, ends), bounds


def _windows(bounds: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last entry of each overlapping window; a short text is one window."""
    size = np.diff(bounds)
    n = np.where(size == 0, 0, np.maximum(1, -(-(size - length) // step) + 1))
    of = np.repeat(np.arange(len(size)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step + bounds[:-1][of]
    return of, at, np.minimum(at + length, bounds[1:][of])


def add_rows(table: np.ndarray, at: np.ndarray, out: np.ndarray, some: int = 2048) -> None:
    """Adds to each row of ``out`` the rows of ``table`` that the row of ``at`` names."""
    held = np.empty((some, table.shape[1]), table.dtype)
    for s in range(0, len(at), some):
        part = out[s : s + some]
        for column in np.ascontiguousarray(at[s : s + some].T).astype(np.intp):
            np.take(table, column, axis=0, out=held[: len(part)], mode="clip")
            part += held[: len(part)]


def scatter_rows(values: np.ndarray, at: np.ndarray, total: np.ndarray, few: int = 64) -> None:
    """Adds row i of ``values`` to each row of ``total`` that row i of ``at`` names (as often as it does).

    Names go by how often they occur, so that the first, second, ... occurrences of all names that have one are added at once; the few names that
    occur oftener than others are added up one by one.
    """
    name = at.ravel()
    order = np.argsort(name, kind="stable") // at.shape[1]
    n = np.bincount(name, minlength=len(total))
    start = np.cumsum(n) - n
    names = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    n, start = n[names], start[names]
    out, held = np.zeros((len(names), values.shape[1]), values.dtype), np.empty((len(names), values.shape[1]), values.dtype)
    turn, left = 0, len(names)
    while left > few:
        np.take(values, order[start[:left] + turn], axis=0, out=held[:left], mode="clip")
        out[:left] += held[:left]
        turn += 1
        left = int(np.searchsorted(-n, -turn))  # names that occur oftener than ``turn`` times
    for i in range(left):
        for s in range(start[i] + turn, start[i] + n[i], len(held)):
            out[i] += values[order[s : min(s + len(held), start[i] + n[i])]].sum(axis=0)
    total[names] += out


def halves(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' words in halves of passages: dimensions (DIMS beyond a text's end) and the number of halves of each text."""
    size = -(-np.diff(bounds) // HALF)
    edges = np.cumsum(np.r_[0, size])
    of = np.repeat(np.arange(len(size)), size)
    word = (bounds[of] + (np.arange(len(of)) - edges[of]) * HALF)[:, None] + np.arange(HALF)
    at = np.r_[h % _U(DIMS), _U(DIMS)].astype(np.uint16)
    return at[np.where(word < bounds[of + 1][:, None], word, len(h))], size.astype(np.int32)


def passage_count(size: np.ndarray) -> int:
    """Passages of texts of so many halves: every two neighbours, or the only one."""
    return int(np.maximum(size[size > 0] - 1, 1).sum())


def add_gram(at: np.ndarray, size: np.ndarray, idf: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds X' X basis to ``total``, X being the unit TF-IDF vectors of all passages of ``halves``; but for a factor idf of each row.

    basis: rows times idf, and a last row of zeros. A half's sum serves both passages that hold it, on the way there and back.
    """
    square = np.r_[idf**2, 0.0]
    follows = np.ones(len(at), bool)  # whether the next half is of the same text
    follows[np.cumsum(size)[size > 0] - 1] = False
    alone = np.zeros(len(at), bool)
    alone[(np.cumsum(size) - size)[size == 1]] = True
    for s in range(0, len(at), HALVES):
        word = at[s : s + HALVES + 1]  # one more for the last half's passage
        own = min(HALVES, len(at) - s)
        joined, single = follows[s : s + own][: len(word) - 1], alone[s : s + own]
        # Squares of the passages' lengths: each word, and each two equal ones within a half or across neighbours.
        inner, across = square[word].sum(axis=1), np.zeros(len(word))
        flat = word.ravel()
        for d in range(1, 2 * HALF):
            first = np.flatnonzero(flat[:-d] == flat[d:])
            half, step = first // HALF, (first + d) // HALF - first // HALF
            weight = 2 * square[flat[first]]
            inner += np.bincount(half[step == 0], weight[step == 0], len(word))
            across += np.bincount(half[step == 1], weight[step == 1], len(word))
        latent = np.zeros((len(word), basis.shape[1]), np.float32)
        add_rows(basis, word, latent)
        back = np.zeros_like(latent)
        back[:own][single] = latent[:own][single] / inner[:own][single, None]
        scale = np.zeros(len(word) - 1, np.float32)
        length = inner[:-1] + inner[1:] + across[:-1]
        scale[: len(joined)][joined] = 1 / length[: len(joined)][joined]
        pair = (latent[:-1] + latent[1:]) * scale[:, None]
        back[:-1] += pair
        back[1:] += pair
        scatter_rows(back, word, total)


def _answer(item: list) -> list:
    return item[-max(3, round(len(item) * ANSWER)) :]


def _answered(text: list, item: list) -> bool:
    """Whether a stretch of twice the item's words holds a share of LCS_ANSWER and the answer, and ends with it.

    Common words alone are met in order in any long text.
    """
    answer = _answer(item)
    for i, w in enumerate(text):
        if w == item[-1]:
            near = text[max(0, i + 1 - 2 * len(item)) : i + 1]
            if lcs_length(near, answer) == len(answer) and lcs_length(near, item) >= LCS_ANSWER * len(item):
                return True
    return False


@dataclass
class LatentSpace:
    """``axes``: latent place of each dimension's word, rarity and the directions' weights included; a last row of zeros.

    ``values``: singular values, largest first.
    """

    axes: np.ndarray
    values: np.ndarray

    def blocks(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Latent vectors of texts' blocks of words: (edges, first word, last word, vectors); text i owns edges[i]:edges[i + 1]."""
        edges = np.cumsum(np.r_[0, -(-np.diff(bounds) // BLOCK)])
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(edges))
        first = bounds[of] + (np.arange(len(of)) - edges[of]) * BLOCK
        last = np.minimum(first + BLOCK, bounds[of + 1])
        at = np.r_[h % _U(DIMS), _U(DIMS)].astype(np.int32)
        word = first[:, None] + np.arange(BLOCK)
        word = at[np.where(word < last[:, None], word, len(h))]
        out = np.zeros((len(first), self.axes.shape[1]), np.float32)
        add_rows(self.axes, word, out)
        return edges, first, last, out


def fit_space(docs: DataFrame, items: list[np.ndarray], rank: int = RANK) -> LatentSpace:
    """The latent space of all passages of ``docs`` (column text) and of the items (hashed words)."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s, e in text_slices(texts, KEEP_BYTES):
                *_, h, bounds = _stripped(texts[s:e])
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in halves(h, bounds)], names=["at", "size"])

    kept = keep(docs.mapInArrow(cut, "at binary, size binary"), "passages")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at, size in zip(batch.column(0), batch.column(1)):
                yield np.frombuffer(at.as_buffer(), np.uint16).reshape(-1, HALF), np.frombuffer(size.as_buffer(), np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences by dimension, and passages."""
        total = np.zeros(DIMS + 1, _I)
        for at, size in rows(batches):
            total += np.bincount(at.ravel(), minlength=DIMS + 1)
            total[DIMS] += passage_count(size) - (at == DIMS).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    total = tree_sum(kept.mapInArrow(count, "n binary"), np.frombuffer, np.ndarray.tobytes, np.zeros(DIMS + 1, _I))
    # Occurrences stand for the passages that hold a word.
    idf = np.log((total[DIMS] + 2) / (total[:DIMS] + 1)).clip(0.05)
    kept = kept.coalesce(max(TASKS, -(-int(total[:DIMS].sum()) // TASK_WORDS)))
    own = halves(np.concatenate([*items, np.empty(0, _U)]), np.cumsum([0, *map(len, items)]))

    def times(basis: np.ndarray) -> np.ndarray:
        """A' A basis, A being all passages and items: one pass.

        Slices of rows are added up apart and come to the driver as such, so that no task and no single value holds all of it.
        """
        weighted = np.zeros((DIMS + 1, basis.shape[1]), np.float32)
        for s in range(0, DIMS, SLICE):
            weighted[s : s + SLICE] = idf[s : s + SLICE, None] * basis[s : s + SLICE]
        weighted[DIMS] = 0
        shared = spark.sparkContext.broadcast(weighted)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.shape)
            for at, size in rows(batches):
                add_gram(at, size, idf, shared.value, total)
            for s in range(0, DIMS, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([total[s : s + SLICE].astype(np.float32).tobytes()], pa.binary())], names=["row", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n = np.frombuffer(raw, np.float32)
                    total[row] = total[row] + n if row in total else n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n.tobytes() for n in total.values()], pa.binary())], names=["row", "n"])

        form = "row long, n binary"
        out = np.zeros(weighted.shape, np.float32)
        for row, raw in kept.mapInArrow(partial, form).repartition(SUM_TASKS, "row").mapInArrow(add, form).collect():
            out[row : row + SLICE] = np.frombuffer(raw, np.float32).reshape(-1, basis.shape[1])
        shared.destroy()
        add_gram(*own, idf, weighted, out)
        for s in range(0, DIMS, SLICE):
            out[s : s + SLICE] *= idf[s : s + SLICE, None]
        return out[:DIMS]

    basis = np.linalg.qr(np.random.default_rng(10).standard_normal((DIMS, rank + OVERSAMPLE), np.float32))[0]
    for _ in range(POWER - 1):
        basis = np.linalg.qr(times(basis))[0]
    product = times(basis)
    # Nystrom: A' A is about P (B' P)^-1 P', P being the product and B the basis.
    values, turn = np.linalg.eigh((basis.T @ product).astype(float))
    some = values > 1e-6 * values[-1]
    half = product @ np.where(some, turn / np.sqrt(np.where(some, values, 1.0)), 0.0).astype(np.float32)
    values, turn = np.linalg.eigh((half.T @ half).astype(float))
    values, turn = np.maximum(values[::-1][:rank], 1e-12), turn[:, ::-1][:, :rank]
    turn = np.where(values > 1e-9 * values[0], turn / np.sqrt(values * (values + values[-1])), 0.0).astype(np.float32)
    axes = np.zeros((DIMS + 1, rank), np.float32)
    for s in range(0, DIMS, SLICE):
        axes[s : s + SLICE] = idf[s : s + SLICE, None] * (half[s : s + SLICE] @ turn)
    return LatentSpace(axes, np.sqrt(values))


class _Search:
    """Leaks of texts: a latent space and a block of item parts (item_id, hashed words)."""

    def __init__(self, space: LatentSpace, parts: list[tuple[int, np.ndarray]], cover: float):
        self.space, self.cover = space, cover
        self.ids = [i for i, _ in parts]
        h = np.concatenate([h for _, h in parts])
        self.vocabulary, flat = np.unique(h, return_inverse=True)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.vocabulary >> _U(48)).astype(_I)] = True
        size = np.array([len(h) for _, h in parts], _I)
        bounds = np.cumsum(np.r_[0, size])
        self.words = np.split(flat.astype(np.int32), bounds[1:-1])
        edges, *_, latent = space.blocks(h, bounds)
        latent = np.add.reduceat(latent, edges[:-1], axis=0)
        probes = latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None] / np.sqrt(size)[:, None].astype(np.float32)
        low = 0
        self.classes = []
        for most, (blocks, step) in CLASSES.items():
            own = np.flatnonzero((size > low) & (size <= most))
            if len(own):
                self.classes.append((most, blocks, step, own, np.ascontiguousarray(probes[own].T)))
            low = most

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first word, last word, item part) of windows that recover enough of an item, wider by half an item."""
        edges, first, last, latent = self.space.blocks(h, bounds)
        sums = [latent]  # of 1, 2, 4, 8 blocks
        for k in range(3):
            sums.append(sums[k][: -(1 << k)] + sums[k][1 << k :])
        for most, blocks, step, own, probes in self.classes:
            text, begin, end = _windows(edges, blocks, step)
            some = max(64, min(_WINDOWS, _CELLS // len(own)))
            for s in range(0, len(text), some):
                i, b, e = (c[s : s + some] for c in (text, begin, end))
                window = np.empty((len(i), latent.shape[1]), np.float32)
                size = e - b
                for n in np.unique(size).tolist():
                    these = np.flatnonzero(size == n)
                    at, part = b[these], 0.0
                    for k in (3, 2, 1, 0):
                        if n >> k & 1:
                            part = part + sums[k][at]
                            at = at + (1 << k)
                    window[these] = part
                least = self.cover * np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-12) / np.sqrt(last[e - 1] - first[b])
                w, t = np.nonzero(window @ probes >= least.astype(np.float32)[:, None])
                yield i[w], np.maximum(bounds[i], first[b] - most // 2)[w], np.minimum(bounds[i + 1], last[e - 1] + most // 2)[w], own[t]

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash among the items' words, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        near = np.flatnonzero(self.table[(h >> _U(48)).astype(_I)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
        out[near] = np.where(self.vocabulary[at] == h[near], at, -1)
        return out

    def leaks(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Of each text: item_id and share of the items that it holds."""
        *_, h, bounds = _stripped(texts)
        out: list[dict[int, float]] = [{} for _ in texts]
        found = list(self.candidates(h, bounds)) if len(h) else []
        if not sum(len(f[0]) for f in found):
            return out
        text, first, last, part = (np.concatenate(c) for c in zip(*found))
        word = self._numbers(h)
        # Where the same word stood before.
        known = np.flatnonzero(word >= 0)
        known = known[np.argsort(word[known], kind="stable")]
        before = np.full(len(word), -1, _I)
        before[known[1:]] = np.where(word[known[1:]] == word[known[:-1]], known[:-1], -1)
        weight = np.zeros(len(self.vocabulary) + 1, np.int32)  # the last stands for words of no item
        order = np.argsort(part, kind="stable")
        start = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        for own in np.split(order, start[1:]):
            t = part[own[0]]
            item = self.words[t]
            weight[item] = np.bincount(item)[item]
            for s in range(0, len(own), 1 << 14):
                some = own[s : s + (1 << 14)]
                size = last[some] - first[some]
                edge = np.cumsum(size) - size
                at = np.repeat(first[some] - edge, size) + np.arange(size.sum())
                # A common subsequence is no longer than the item's words that are in the window at all.
                here = np.where(before[at] < np.repeat(first[some], size), weight[word[at]], 0)
                for c in some[np.add.reduceat(here, edge) >= LCS_ANSWER * len(item)].tolist():
                    self._confirm(out[text[c]], t, item.tolist(), word[first[c] : last[c]].tolist())
            weight[item] = 0
        return out

    def _confirm(self, found: dict[int, float], t: int, item: list, near: list) -> None:
        share = lcs_length(near, item) / len(item)
        if share >= LCS or share >= LCS_ANSWER and _answered(near, item):
            found[self.ids[t]] = max(share, found.get(self.ids[t], 0.0))


def item_parts(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(item_id, hashed words) of every item's passages of at most ITEM_WORDS words; no word is left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    parts: list[tuple[int, np.ndarray]] = []
    for row in sorted(items.toLocalIterator(), key=lambda r: (r.item_id, r.text)):
        ws = _clean(words(row.text, True))
        raw = b" ".join(ws)
        h = hash_spans(raw, *word_spans(raw))
        # A short rest goes together with the words before it.
        starts = range(0, len(h), ITEM_WORDS)
        parts += [(row.item_id, h[max(0, len(h) - ITEM_WORDS) if s and len(h) - s < ITEM_WORDS else s : s + ITEM_WORDS]) for s in starts]
    return parts


def with_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cover: float = COVER) -> DataFrame:
    """docs with a column ``leaks``: array of (item_id, share), by item_id, of the benchmark items that a row's text holds.

    docs: text and any other columns (one called ``leaks`` is replaced); benchmark: item_id, text. share: common
    subsequence as a share of the item's words. Every row is judged by its own text, whatever its doc_id (null and
    repeated ones too). Null and empty texts hold nothing; items without words are never found. Items of more than
    ITEM_WORDS words are compared by passages of that length. An empty benchmark gives empty arrays.
    """
    spark = docs.sparkSession
    form = "array<struct<item_id: bigint, share: double>>"
    parts = item_parts(benchmark)
    text = F.col("text").cast("string")
    out = docs.withColumn("leaks", F.array().cast(form))
    if not parts:
        return out
    space = fit_space(docs.select(text.alias("text")).where("text is not null"), [h for _, h in parts], rank)

    def search(block: list[tuple[int, np.ndarray]]):
        shared = spark.sparkContext.broadcast(_Search(space, block, cover))

        @F.arrow_udf(form)
        def leaks(text: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            found = [sorted(x.items()) for s, e in text_slices(texts, SEARCH_BYTES) for x in shared.value.leaks(texts[s:e])]
            return pa.array([[{"item_id": i, "share": v} for i, v in x] for x in found], pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))

        return leaks(text)

    columns = [search(parts[s : s + ITEM_BLOCK]) for s in range(0, len(parts), ITEM_BLOCK)]
    if len(columns) == 1:
        return out.withColumn("leaks", columns[0])
    # Parts of one item may lie in two blocks.
    every = F.concat(*columns)
    best = F.transform(F.array_sort(F.array_distinct(F.transform(every, lambda x: x.item_id))), lambda i: F.struct(i.alias("item_id"), F.array_max(F.transform(F.filter(every, lambda x: x.item_id == i), lambda x: x.share)).alias("share")))
    return out.withColumn("leaks", best)


def mark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, contaminated, n_items, items (sorted item_ids), share (largest, 0 if none)."""
    out = with_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.transform("leaks", lambda x: x.item_id).alias("items"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x.share)), F.lit(0.0)).alias("share"),
    )


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return mark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
