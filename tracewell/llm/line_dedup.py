"""Line dedup by an exact set-similarity join (operator 1).

A line is the set of its words (A-Z lower-cased). Words are ordered by rarity; two sets of
Jaccard similarity t share a word among the first |x| - ceil(t |x|) + 1 of each, so lines
meet only under the words of these prefixes. There, pairs pass a length filter, a position
filter (a pair is dropped where the words left after the shared one cannot reach the
overlap), and a bitmap filter: the words' parity bits, whose differing bits are no more
than the differing words. What passes is verified on whole sets. A line goes if an
earlier one, by (doc_id, line number), is similar, on the input.

Rarity comes from word counts over all documents, held in a sketch of fixed size, which
orders words alike everywhere; the join is exact under any order. A pair counts under its
first common word alone, so a line meets only partners that the words from there on can
reach; words that occur very often meet in twos, which deals them over many buckets. A line
with many partners under one key asks its nearest first, and lines that look alike ask the
earliest of them; only lines that none of those removes ask all the others. So a line that
a third of all documents hold costs one question each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracewell.llm.shared import batches_of, bucket_count, bucketed_rows, code, decode, pack, packed_schema, rows_of, text_bytes, tree_sum, unpack
from tracewell.llm.textops import Words, mix, slices, text_slices, tokenize

_U, _I = np.uint64, np.int64
#: Counters of the rarity sketch (8 bytes each).
SKETCH = 1 << 20
FIRST = 1
#: A word that occurs more often meets only together with a further word of the line.
HOT = 16_384
#: Pairs that a task tests at a time.
PAIRS = 1 << 19
_NUM, _DEN = 3, 4


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of all words, added up in SKETCH counters by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, _I)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s, e in text_slices(texts):
                total += np.bincount((tokenize(texts[s:e], True).hashes % _U(SKETCH)).astype(_I), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array([code(total)], pa.binary())], names=["n"])

    return tree_sum(docs.select("text").mapInArrow(count, "n binary"), decode, code, np.zeros(SKETCH, _I))


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m words with Jaccard similarity 3/4: ceil(3 (n + m) / 7)."""
    return -(-_NUM * (n + m) // (_NUM + _DEN))


def _width(n: np.ndarray) -> np.ndarray:
    """64-bit words of a line's bitmap: a power of two of at least 4/3 bits for each of its n words."""
    return 1 << np.ceil(np.log2(np.maximum(n, 48) / 48)).astype(_I)


class _Bitmaps:
    """Parity bitmaps of one or two widths per pair; the wider one is folded to the narrower."""

    def __init__(self, flat: np.ndarray, width: np.ndarray):
        self.flat, self.width = flat, width
        self.start = np.cumsum(width) - width
        #: All words folded to one, for a first test.
        self.fold = np.bitwise_xor.reduceat(flat, self.start) if len(width) else flat

    def mixed(self) -> np.ndarray:
        """A hash of each line's bitmap."""
        number = np.arange(len(self.flat)) - np.repeat(self.start, self.width)
        parts = mix(self.flat + number.astype(_U))
        return np.add.reduceat(parts, self.start) if len(self.start) else parts

    def may_reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fold[i] ^ self.fold[j]) <= most

    def _rows(self, i: np.ndarray, width: int) -> np.ndarray:
        own = self.flat[self.start[i][:, None] + np.arange(width)]
        more = np.flatnonzero(self.width[i] > width)
        if len(more):
            own[more] ^= self.flat[self.start[i[more]][:, None] + width + np.arange(width)]
        return own

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of each pair, no more than the differing words."""
        out = np.zeros(len(i), _I)
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            if w == 1:
                out[at] = np.bitwise_count(self.fold[i[at]] ^ self.fold[j[at]])
                continue
            for s in range(0, len(at), 200_000):
                part = at[s : s + 200_000]
                out[part] = np.bitwise_count(self._rows(i[part], w) ^ self._rows(j[part], w)).sum(axis=1)
        return out


def _line_order(line: np.ndarray, level: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of words by line, then rarity level, then hash: one sort where all three fit 64 bits."""
    if len(line) and line[-1] < 1 << 20:
        key = line.astype(_U) << _U(44) | level.astype(_U) << _U(36) | h >> _U(28)
        order = np.argsort(key)
        key, ordered = key[order], h[order]
        if not ((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])).any():
            return order
    return np.lexsort((h, level, line))


class _Lines:
    """Distinct word hashes of each line of some texts, by rarity level and hash."""

    def __init__(self, texts: list[str | None], levels: np.ndarray | None = None):
        text: Words = tokenize(texts, True)
        breaks = np.flatnonzero(np.frombuffer(text.raw, np.uint8) == 10)
        line = np.searchsorted(breaks, text.starts)
        level = levels[(text.hashes % _U(SKETCH)).astype(_I)] if levels is not None else np.zeros(len(line), np.uint8)
        order = _line_order(line, level, text.hashes)
        line, h = line[order], text.hashes[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (h[1:] != h[:-1])][: len(line)]
        line, self.h = line[new], h[new]
        self.level = level[order][new]
        self.start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
        self.size = np.diff(np.r_[self.start, len(line)])
        lines_of = np.array([(t or "").count("\n") + 1 for t in texts], _I)
        first = np.cumsum(np.r_[0, lines_of])
        self.line = line[self.start]  # number among all lines
        self.text = np.searchsorted(first, self.line, side="right") - 1
        self.no = (self.line - first[self.text]).astype(np.int32)

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of lines i and j are equal."""
        out = self.size[i] == self.size[j]
        at = np.flatnonzero(out)
        x, y = self.h[spread(self.start[i[at]], self.size[i[at]])], self.h[spread(self.start[j[at]], self.size[i[at]])]
        if len(at):
            edge = np.cumsum(self.size[i[at]]) - self.size[i[at]]
            out[at] = np.logical_and.reduceat(x == y, edge)
        return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Rarity in 256 levels, an eighth of a doubling each."""
    return np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)


def most_words(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of the largest partner of an n-word line whose first shared word stands at ``at``: n - at words reach the overlap."""
    return (_NUM + _DEN) * (n - at) // _NUM - n


def line_keys(lines: _Lines, asks: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key) under which the asking lines meet.

    Similar lines share their first common word in both prefixes. Under a word of the hot levels they share the
    next common word too (any two similar lines of two words or more have two in common), so the key holds both,
    and the place is the one before the second.
    """
    of = np.repeat(np.arange(len(lines.start)), lines.size)
    at = np.arange(len(lines.h)) - lines.start[of]
    long = lines.size - (-(-_NUM * lines.size // _DEN)) + 1
    take = np.flatnonzero(asks[of] & (at < long[of]))
    common = (lines.level[take] >= hot) & (lines.size[of[take]] > 1)
    two, one = take[common], take[~common]
    n = np.minimum(long, lines.size - 1)[of[two]] - at[two]
    first, second = np.repeat(two, n), spread(two + 1, n)
    keys = np.r_[lines.h[one], mix(lines.h[first] * _U(0x9E3779B97F4A7C15) + lines.h[second])]
    return np.r_[of[one], of[first]], np.r_[at[one], at[second] - 1], keys


def candidate_pairs(x: np.ndarray, n: np.ndarray, at: np.ndarray, doc: np.ndarray, no: np.ndarray, bits: _Bitmaps, wanted: np.ndarray | None = None):
    """(later, earlier, distance, more) of entries under one key whose lines may be similar, as indexes.

    Without ``wanted``: the FIRST nearest earlier partners of each entry (of equally near ones the earliest, so that a
    line asks the same one under all its keys); entries that look alike ask only the earliest of them, and nobody asks
    the others. ``more``: there were other partners. With ``wanted`` (a mask of entries): all earlier partners of those.
    """
    most = most_words(n, at)
    head, members = np.arange(len(x)), np.ones(len(x), _I)
    parts = []
    if wanted is None:
        look = mix(x.astype(_U) << _U(32) ^ mix(n.astype(_U) << _U(32) | at.astype(_U)) ^ bits.mixed())
        order = np.argsort(look)
        new = np.r_[True, look[order][1:] != look[order][:-1]][: len(order)]
        group, size = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(order)])
        many = order[size[group] > 1]
        many = many[np.lexsort((no[many], doc[many], look[many]))]
        new = np.r_[True, look[many][1:] != look[many][:-1]][: len(many)]
        first = many[np.flatnonzero(new)][np.cumsum(new) - 1] if len(many) else many
        head[many] = first
        members[first] = size[size > 1][np.cumsum(new) - 1] if len(many) else 0
        others = many[(many != first) & ((doc[many] != doc[first]) | (no[many] != no[first]))]
        parts.append((others, head[others], np.zeros(len(others), _I), np.ones(len(others), bool)))
    entry = np.flatnonzero(head == np.arange(len(x)))
    place = x.astype(_I) << 31 | np.minimum(n, 2**31 - 1)
    entry = entry[np.argsort(place[entry])]
    place = place[entry]
    word = x.astype(_I)[entry] << 31
    reach = np.searchsorted(place, word | np.maximum(0, most[entry]), side="right")
    here = np.arange(len(entry))
    if wanted is None:
        left, low, high = here, here + 1, reach
    else:
        left = np.flatnonzero(wanted[entry])
        low, high = np.searchsorted(place, word[left] | -(-_NUM * n[entry[left]] // _DEN)), reach[left]
    size = np.maximum(0, high - low)
    held = 0

    def nearest(parts):
        later, earlier, far, more = (np.concatenate(c) for c in zip(*parts))
        if wanted is not None:
            return later, earlier, far, more
        order = np.lexsort((no[earlier], doc[earlier], far, later))
        later, earlier, far, more = later[order], earlier[order], far[order], more[order]
        new = np.r_[True, later[1:] != later[:-1]][: len(later)]
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        more = (np.diff(np.r_[begin, len(later)]) > FIRST)[run] | (np.logical_or.reduceat(more, begin)[run] if len(begin) else more)
        first = np.arange(len(later)) - begin[run] < FIRST
        return later[first], earlier[first], far[first], more[first]

    for s, e in slices(size, PAIRS):
        i, j = np.repeat(left[s:e], size[s:e]), spread(low[s:e], size[s:e])
        i, j = entry[i], entry[j]
        good = n[i] <= most[j]
        i, j = i[good], j[good]
        if wanted is not None:
            good = n[j] <= most[i]
            i, j = i[good], j[good]
        limit = n[i] + n[j] - 2 * need(n[i], n[j])
        good = bits.may_reach(i, j, limit)
        i, j, limit = i[good], j[good], limit[good]
        far = bits.distance(i, j)
        first = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (no[i] < no[j]))
        good = (far <= limit) & (first | (doc[i] != doc[j]) | (no[i] != no[j]))
        later, earlier, far = np.where(first, j, i)[good], np.where(first, i, j)[good], far[good]
        if wanted is not None:
            own = wanted[later]
            later, earlier, far = later[own], earlier[own], far[own]
        if len(later):
            parts.append((later, earlier, far, members[earlier] > 1))
            held += len(later)
            if held > PAIRS and wanted is None:
                parts, held = [nearest(parts)], 0
    return nearest(parts) if parts else tuple(np.empty(0, t) for t in (_I, _I, _I, bool))


def similar_sets(h: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, other: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether set i[q] (``h`` from start, sorted) and question q's set (``other`` from begin, width long) are similar."""
    both = np.zeros(len(i), _I)
    for s, e in slices(width, PAIRS):
        # The sets in use, one after the other, are sorted as a whole by number and hash.
        used, number = np.unique(i[s:e], return_inverse=True)
        words = h[spread(start[used], size[used])]
        keys = np.repeat(np.arange(len(used)), size[used]).astype(_U) << _U(40) | words >> _U(24)
        asked = other[spread(begin[s:e], width[s:e])]
        want = np.repeat(number, width[s:e]).astype(_U) << _U(40) | asked >> _U(24)
        at = np.searchsorted(keys, want)
        hit = np.zeros(len(asked), _I)
        live = np.flatnonzero(at < len(keys))
        while len(live := live[keys[at[live]] == want[live]]):
            hit[live] = words[at[live]] == asked[live]
            live = live[hit[live] == 0]  # another word with the same key
            at[live] += 1
            live = live[at[live] < len(keys)]
        both[s:e] = np.add.reduceat(hit, np.cumsum(width[s:e]) - width[s:e])
    return both >= need(size[i], width)


def _cut_bitmaps(lines: _Lines, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, bitmaps) of the asking lines, by width."""
    of = np.repeat(np.arange(len(lines.start)), lines.size)
    mixed = mix(lines.h + _U(9))
    wide = _width(lines.size)
    for width in np.unique(wide[asks]).tolist():
        own = asks & (wide == width)
        bits = np.zeros((len(lines.start), width), _U)
        word = np.flatnonzero(own[of])
        np.bitwise_xor.at(bits, (of[word], ((mixed[word] >> _U(6)) % _U(width)).astype(_I)), _U(1) << (mixed[word] & _U(63)))
        yield own, bits


def _table(parts, *columns) -> pa.Table:
    parts = list(batches_of(parts))
    return pa.Table.from_batches(parts) if parts else pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in columns)]).empty_table()


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of some columns, in order of the first, then the second and so on."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def _sets_of(texts: pa.Table | None, doc: np.ndarray, no: np.ndarray) -> Iterator[tuple[dict[tuple[int, int], list[int]], _Lines]]:
    """Of wanted lines (doc, no): their sets, and the numbers of the sets of each line (rows may repeat a doc_id)."""
    if texts is None or not len(doc):
        return
    wanted: dict[int, list[int]] = {}
    for d, k in zip(doc.tolist(), no.tolist()):
        wanted.setdefault(d, []).append(k)
    own = texts.column("doc_id").combine_chunks()
    own = texts.filter(pa.compute.is_in(own, pa.array(list(wanted), pa.int64())))
    names, found = [], []
    for d, t in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist()):
        cut = (t or "").split("\n")
        for k in wanted[d]:
            if k < len(cut):
                names.append((d, k))
                found.append(cut[k])
    for s, e in text_slices(found):
        lines = _Lines(found[s:e])
        at: dict[tuple[int, int], list[int]] = {}
        for x, line in enumerate(lines.text.tolist()):
            at.setdefault(names[s + line], []).append(x)
        yield at, lines


def remove_similar_lines(docs: DataFrame, carry: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each line that has Jaccard similarity 3/4 or more to an earlier line of any document.

    docs: doc_id, text and any other columns. Returns doc_id, n_lines, n_removed, kept_text (kept lines joined by
    a line feed), one row per input row, with the other columns of docs if ``carry`` (but for columns of docs that
    are called like one of those four). Lines are cut at line feeds; lines without words stay and match nothing.
    Null text: no lines, null kept_text. Rows with a null doc_id stay whole and remove nothing. Rows that repeat a
    doc_id count as equally early; equal line numbers of such rows do not remove each other. Words that occur more
    than ``hot`` times meet in twos; the result is the same for any value.
    """
    taken = ("doc_id", "text", "n_lines", "n_removed", "kept_text")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*others).alias("carried")] if others else []))
    carried = len(others) > 0
    docs = rows.select("doc_id", "text")
    spark = docs.sparkSession
    words = text_bytes(docs) / 6
    buckets, doc_buckets = bucket_count(words / 4), bucket_count(words / 2)
    levels = spark.sparkContext.broadcast(levels_of(word_counts(docs)))
    hot_level = int(levels_of(np.array([hot]))[0]) + 1

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in text_slices(all_texts):
                ids = all_ids[s:e]
                lines = _Lines([t if i is not None else None for i, t in zip(ids, all_texts[s:e])], levels.value)
                if not len(lines.start):
                    continue
                doc = np.array([i or 0 for i in ids], _I)[lines.text]
                # Equal sets of one slice: all but the earliest go at once and ask nothing.
                same = np.add.reduceat(mix(lines.h + _U(9)), lines.start)
                order = np.lexsort((lines.no, doc, same))
                new = np.r_[True, same[order][1:] != same[order][:-1]]
                head = np.empty(len(order), _I)
                head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                # Rows that repeat a doc_id: an equal place does not go.
                gone = (doc != doc[head]) | (lines.no != lines.no[head])
                gone[gone] = lines.equal(np.flatnonzero(gone), head[gone])
                if gone.any():
                    nothing = np.zeros(gone.sum(), np.int32)
                    yield from batches_of([pack(doc[gone] % doc_buckets, {"x": np.empty((len(nothing), 0), np.uint32), "bits": np.empty((len(nothing), 0), _U), "n": nothing, "at": nothing, "doc": doc[gone], "no": lines.no[gone]})])
                line, at, key = line_keys(lines, ~gone, hot_level)
                for own, bits in _cut_bitmaps(lines, ~gone):
                    take = np.flatnonzero(own[line])
                    i, h = line[take], key[take]
                    yield from batches_of([pack((h % _U(buckets)).astype(_I), {"x": (h >> _U(32)).astype(np.uint32), "bits": bits[i], "n": lines.size[i].astype(np.int32), "at": at[take].astype(np.int32), "doc": doc[i], "no": lines.no[i]})])

    def pairs_of(table: pa.Table, only: pa.Table | None) -> tuple[np.ndarray, ...]:
        """(later doc, no, earlier doc, no, asks again) of the candidate pairs of a bucket."""
        n, doc, no = unpack(table, "n", np.int32).astype(_I), unpack(table, "doc", _I), unpack(table, "no", np.int32)
        real = n > 0  # the others are lines that went already
        n, doc, no = n[real], doc[real], no[real]
        x, at, bits = unpack(table, "x", np.uint32), unpack(table, "at", np.int32)[real].astype(_I), _Bitmaps(unpack(table, "bits", _U), _width(n))
        wanted = None
        if only is not None:
            asked = set(zip(unpack(only, "doc", _I).tolist(), unpack(only, "no", np.int32).tolist()))
            wanted = np.isin(doc, np.array([d for d, _ in asked], _I))
            wanted[wanted] = [(d, k) in asked for d, k in zip(doc[wanted].tolist(), no[wanted].tolist())]
        later, earlier, _, more = candidate_pairs(x, n, at, doc, no, bits, wanted)
        return doc[later], no[later], doc[earlier], no[earlier], more

    def routed(d, k, d2, k2, more):
        d, k, d2, k2, more = _distinct(d, k, d2, k2, more)
        return pack(d % doc_buckets, {"doc": d, "no": k, "doc2": d2, "no2": k2, "more": more})

    def meet(table: pa.Table) -> pa.Table:
        gone = unpack(table, "n", np.int32) == 0
        bucket = table.column("bucket")[0].as_py()
        d, k = unpack(table, "doc", _I)[gone], unpack(table, "no", np.int32)[gone]
        out = [routed(d, k, np.full(len(d), -1, _I), np.zeros(len(d), np.int32), np.full(len(d), -1, np.int32))]
        d, k, d2, k2, more = pairs_of(table, None)
        return _table([*out, routed(d, k, d2, k2, np.where(more, bucket, -1).astype(np.int32))], "doc", "no", "doc2", "no2", "more")

    def meet_again(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not table.num_rows:
            return _table([], "doc", "no", "doc2", "no2", "more")
        d, k, d2, k2, _ = pairs_of(table, asked)
        return _table([routed(d, k, d2, k2, np.full(len(d), -1, np.int32))], "doc", "no", "doc2", "no2", "more")

    def ask(blobs: pa.Table, pairs: pa.Table) -> pa.Table:
        """Send each later line's set to its earlier line's documents."""
        d, k, d2, k2 = _distinct(unpack(pairs, "doc", _I), unpack(pairs, "no", np.int32), unpack(pairs, "doc2", _I), unpack(pairs, "no2", np.int32))
        real = np.flatnonzero(d2 != -1)
        d, k, d2, k2 = d[real], k[real], d2[real], k2[real]
        out = []
        for at, lines in _sets_of(rows_of(blobs) if len(d) else None, *_distinct(d, k)):
            asking = [(q, x) for q, name in enumerate(zip(d.tolist(), k.tolist())) for x in at.get(name, ())]
            q, x = np.array(asking, _I).reshape(-1, 2).T
            bucket, size = d2[q] % doc_buckets, lines.size[x]
            order = np.argsort(bucket, kind="stable")
            q, x, size, bucket = q[order], x[order], size[order], bucket[order]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            for s, e in zip(begin.tolist(), np.r_[begin[1:], len(bucket)].tolist()):
                part = q[s:e]
                sets = lines.h[spread(lines.start[x[s:e]], size[s:e])].tobytes()
                coded = [code(v) for v in (d2[part], k2[part], d[part], k[part], size[s:e].astype(np.int32))]
                out.append(pa.RecordBatch.from_arrays([pa.array([bucket[s]]), *(pa.array([c], pa.binary()) for c in (*coded, sets))], names=["bucket", "to", "at", "doc", "no", "size", "set"]))
        return _table(out, "to", "at", "doc", "no", "size", "set")

    def answer(blobs: pa.Table, asked: pa.Table) -> pa.Table:
        to, at, d, k, size = unpack(asked, "to", _I), unpack(asked, "at", np.int32), unpack(asked, "doc", _I), unpack(asked, "no", np.int32), unpack(asked, "size", np.int32).astype(_I)
        flat = unpack(asked, "set", _U)
        begin = np.cumsum(size) - size
        gone = np.zeros(len(to), bool)
        for places, lines in _sets_of(rows_of(blobs) if len(to) else None, *_distinct(to, at)):
            told = [(q, x) for q, name in enumerate(zip(to.tolist(), at.tolist())) for x in places.get(name, ())]
            q, x = np.array(told, _I).reshape(-1, 2).T
            np.logical_or.at(gone, q, similar_sets(lines.h, lines.start, lines.size, x, flat, begin[q], size[q]))
        d, k = _distinct(d[gone], k[gone])
        return _table([pack(d % doc_buckets, {"doc": d, "no": k})], "doc", "no")

    def again(pairs: pa.Table, gone: pa.Table) -> pa.Table:
        """Lines with more partners than they asked for, and that nothing has removed so far."""
        more = unpack(pairs, "more", np.int32)
        b, d, k = _distinct(more[more >= 0], unpack(pairs, "doc", _I)[more >= 0], unpack(pairs, "no", np.int32)[more >= 0])
        went = set(zip(unpack(gone, "doc", _I).tolist(), unpack(gone, "no", np.int32).tolist()))
        left = np.array([name not in went for name in zip(d.tolist(), k.tolist())], bool)
        return _table([pack(b[left].astype(_I), {"doc": d[left], "no": k[left]})], "doc", "no")

    def kept(blobs: pa.Table, gone: pa.Table) -> pa.Table:
        texts = rows_of(blobs)
        if texts is None:
            return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_form]).empty_table()
        went: dict[int, set] = {}
        for x, y in zip(unpack(gone, "doc", _I).tolist(), unpack(gone, "no", np.int32).tolist()):
            went.setdefault(x, set()).add(y)
        ids, n, removed, out = texts.column("doc_id").to_pylist(), [], [], []
        for i, t in zip(ids, texts.column("text").to_pylist()):
            lines = t.split("\n") if t is not None else []
            bad = {x for x in went.get(i, ()) if x < len(lines) and lines[x].strip(" \t\r\v\f")} if i is not None else set()
            n.append(len(lines))
            removed.append(len(bad))
            out.append(t if not bad else "\n".join([x for j, x in enumerate(lines) if j not in bad]))
        made = {"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(out, pa.string())}
        return pa.table(made | ({"carried": texts.column("carried")} if carried else {}))

    by_doc = bucketed_rows(rows, doc_buckets).groupBy("bucket")
    out_form = StructType([StructField("doc_id", LongType()), StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), *(f for f in rows.schema if f.name == "carried")])
    entries = docs.mapInArrow(entries_of, packed_schema("x", "bits", "n", "at", "doc", "no")).groupBy("bucket")
    pair_form, gone_form = packed_schema("doc", "no", "doc2", "no2", "more"), packed_schema("doc", "no")
    ask_form = packed_schema("to", "at", "doc", "no", "size", "set")

    def resolve(pairs: DataFrame) -> DataFrame:
        asked = by_doc.cogroup(pairs.groupBy("bucket")).applyInArrow(ask, ask_form)
        return by_doc.cogroup(asked.groupBy("bucket")).applyInArrow(answer, gone_form)

    def settled(pairs: pa.Table) -> pa.Table:
        d2, d, k = unpack(pairs, "doc2", _I), unpack(pairs, "doc", _I), unpack(pairs, "no", np.int32)
        d, k = d[d2 == -1], k[d2 == -1]
        return _table([pack(d % doc_buckets, {"doc": d, "no": k})], "doc", "no")

    pairs = entries.applyInArrow(meet, pair_form)
    first = resolve(pairs)
    still = pairs.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(again, gone_form)
    second = resolve(entries.cogroup(still.groupBy("bucket")).applyInArrow(meet_again, pair_form))
    gone = pairs.groupBy("bucket").applyInArrow(settled, gone_form).unionByName(first).unionByName(second)
    out = by_doc.cogroup(gone.groupBy("bucket")).applyInArrow(kept, out_form)
    return out.select("doc_id", "n_lines", "n_removed", "kept_text", *(["carried.*"] if others else []))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_similar_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
