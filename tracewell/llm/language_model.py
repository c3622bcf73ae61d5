"""Language-model scores by a log-bilinear model with noise-contrastive estimation (operator 13).

Counts. Texts are cut into words once; a task numbers the distinct words of up to ``SLICE_BYTES`` of text and writes word
numbers. Distinct words with their training counts meet by hash of the word, where counts of all slices are added up, and each
slice gets the totals of its own words back. So the vocabulary is never in one place.

Model. The ``HEADS`` most frequent words and the end of a text are classes of their own, all other words share ``TAILS`` classes by
their ending. The log-bilinear model predicts a vector from the ``CONTEXT`` classes before a token, sum of C_i r(class), and scores each class by its
product with the class's vector q plus a bias. It learns by noise-contrastive estimation from every training token: tasks make numpy
gradient steps from the same start over their own tokens, and their models are averaged by tokens, ``ROUNDS`` times.

Scores. Matrix products of batches of contexts with all class vectors, normalised by their sum, give the probability of a
token's class; a word within a tail class has its discounted share of the class's training tokens, and the discounts are the
share of the words that training has not seen, counted as one word a class. So probabilities of a token sum to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import _packer, _unpacker, bucket_count, code, decode, keep, pack, packed_schema, tree_sum
from tracewell.llm.textops import distinct_words, slices, tokenize

FOLDS, HELD_OUT = 7, 2
HEADS, TAILS, CONTEXT, WIDTH = 127, 128, 2, 16
#: Class of the end of a text, number of classes, and the class that stands before a text's first token.
END, CLASSES = HEADS, HEADS + 1 + TAILS
START = CLASSES
BATCH, NOISE, ROUNDS, RATE, DISCOUNT = 2048, 32, 2, 0.1, 0.5
#: Bytes of text whose words are numbered together, and of those cut into words at once.
SLICE_BYTES, PART_BYTES = 32_000_000, 4_000_000
#: Tokens that one matrix product scores.
SCORED = 512
_I = np.int64


def _held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _squeezed(raw: bytes) -> bytes:
    return _packer.compress(raw)


def _shrunk(values: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    return _packer.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _grown(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(_I)


def word_slices(docs: DataFrame) -> DataFrame:
    """(slice, ids, held, n, tokens, words, counts): slices of documents as numbers of their own distinct words.

    ids: doc_ids with their nulls; n: words of each document; words: joined by line feeds; counts: occurrences of each in training documents.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = ["slice", "ids", "held", "n", "tokens", "words", "counts"], 0
        number: dict[bytes, int] = {}
        ids, held, n, tokens, size = [], [], [], [], 0

        def piece() -> pa.RecordBatch:
            flag, length, token = np.concatenate(held), np.concatenate(n), np.concatenate(tokens) if tokens else np.empty(0, _I)
            counts = np.bincount(token[np.repeat(~flag, length)], minlength=len(number))
            values = [(TaskContext.get().partitionId() << 24) + part, sum(ids, []), flag.tolist(), code(length), _shrunk(token), _squeezed(b"\n".join(number)), code(counts.astype(_I))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            doc_ids, flags = batch.column(0), np.array(batch.column(1))
            length = np.array([len(t or "") for t in batch.column(2).to_pylist()])
            for s, e in slices(length, PART_BYTES):
                found = tokenize(batch.column(2).slice(s, e - s).to_pylist(), lower=True)
                first, of = distinct_words(found)
                own = np.array([number.setdefault(found.raw[a:b], len(number)) for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())], _I)
                ids.append(doc_ids.slice(s, e - s).to_pylist())
                held.append(flags[s:e])
                n.append(np.diff(found.bounds).astype(_I))
                tokens.append(own[of].astype(np.uint32) if len(own) else np.empty(0, np.uint32))
                size += int(length[s:e].sum())
                if size >= SLICE_BYTES:
                    yield piece()
                    part += 1
                    number, ids, held, n, tokens, size = {}, [], [], [], [], 0
        if ids:
            yield piece()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", _held_out(F.col("doc_id")).alias("held"), "text")
    return texts.mapInArrow(rows, "slice long, ids array<long>, held array<boolean>, n binary, tokens binary, words binary, counts binary")


def _words(raw: bytes) -> list[bytes]:
    plain = _unpacker.decompress(raw)
    return plain.split(b"\n") if plain else []


def tail_class(word: bytes) -> int:
    return HEADS + 1 + crc32(word[-3:]) % TAILS


def total_counts(slices_table: DataFrame) -> DataFrame:
    """(bucket, slice, at, counts, top, tails): training counts of the words ``at`` of a slice over all slices.

    Each bucket's row without a slice has its most frequent words with their counts (top), and of each tail class the tokens and
    the distinct words, as if all words were in tails.
    """
    words = slices_table.agg(F.sum(F.length("counts"))).first()[0] or 0  # a byte or two a word
    buckets = bucket_count(words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, counts = _words(row["words"]), decode(row["counts"], _I)
                bucket = np.fromiter((crc32(w) % buckets for w in known), _I, len(known))
                packed = pack(bucket, {"at": np.arange(len(known)), "counts": counts})
                if packed is None:
                    continue
                order = np.argsort(bucket, kind="stable").tolist()
                edge = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))].tolist()
                own = [_squeezed(b"\n".join([known[i] for i in order[edge[b] : edge[b + 1]]])) for b in packed.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(own, pa.binary()), pa.array([row["slice"]] * len(own))], names=["bucket", "at", "counts", "words", "slice"])

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        rows = table.select(["slice", "at", "words", "counts"]).to_pylist()
        for row in rows:
            row["words"] = _words(row["words"])
            for w, c in zip(row["words"], decode(row["counts"], _I).tolist()):
                total[w] = total.get(w, 0) + c
        seen = [(w, c) for w, c in total.items() if c]
        top = sorted(seen, key=lambda x: (-x[1], x[0]))[:HEADS]
        tails = np.zeros((2, TAILS), _I)
        place = np.fromiter((tail_class(w) - HEADS - 1 for w, _ in seen), _I, len(seen))
        np.add.at(tails[0], place, np.array([c for _, c in seen], _I))
        np.add.at(tails[1], place, 1)
        empty = [None] * len(rows)
        return pa.table(
            {
                "slice": pa.array([*(r["slice"] for r in rows), None], pa.int64()),
                "at": pa.array([*(r["at"] for r in rows), None], pa.binary()),
                "counts": pa.array([*(code(np.array([total[w] for w in r["words"]], _I)) for r in rows), None], pa.binary()),
                "top": pa.array([*empty, [{"word": w, "n": c} for w, c in top]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                "tails": pa.array([*empty, tails.tobytes()], pa.binary()),
            }
        )

    dealt = slices_table.select("slice", "words", "counts").mapInArrow(deal, packed_schema("at", "counts") + ", words binary, slice long")
    return dealt.groupBy("bucket").applyInArrow(add, "slice long, at binary, counts binary, top array<struct<word: binary, n: long>>, tails binary")


def _array_sum(parts: DataFrame, shape, kind=_I) -> np.ndarray:
    """Sum of the arrays in a one-column table, first within each task."""
    name = parts.columns[0]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(raw, kind) for batch in batches for raw in batch.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tobytes()], pa.binary())], names=[name])

    return tree_sum(parts.mapInArrow(once, f"{name} binary"), lambda raw, k: np.frombuffer(raw, k), np.ndarray.tobytes, np.zeros(shape, kind))


class ClassTable:
    """Head words, and of each class the training tokens and distinct words; N and V of all."""

    def __init__(self, heads: list[tuple[bytes, int]], tails: np.ndarray, texts: int):
        self.heads = {w: i for i, (w, _) in enumerate(heads)}
        self.tokens, self.types = np.zeros(CLASSES, _I), np.zeros(CLASSES, _I)
        self.tokens[END + 1 :], self.types[END + 1 :] = tails
        for w, n in heads:
            self.tokens[self.heads[w]], self.types[self.heads[w]] = n, 1
            self.tokens[tail_class(w)] -= n
            self.types[tail_class(w)] -= 1
        self.tokens[END], self.types[END] = texts, int(texts > 0)
        self.n, self.v = int(self.tokens.sum()), int(self.types.sum())

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of words with such training counts by the add-one unigram model."""
        return np.log10((count + 1) / (self.n + (self.v + 1)))

    def within(self, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of words with such training counts within their classes."""
        n, v = self.tokens[kind], self.types[kind]
        share = np.where(count > 0, count - DISCOUNT, DISCOUNT * v) / np.maximum(n, 1)
        return np.where(kind <= END, 0.0, np.log10(np.where(n > 0, share, 1.0)))


def coded_slices(slices_table: DataFrame, totals: DataFrame, known: ClassTable) -> DataFrame:
    """(docs, classes): of each slice its documents' figures, and the classes of all their tokens, ends included."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = right.select(["at", "counts"]).to_pylist()
        for row in left.to_pylist():
            words, n, token = _words(row["words"]), decode(row["n"], _I), _grown(row["tokens"])
            count = np.zeros(len(words), _I)
            for part in parts:
                count[decode(part["at"], _I)] = decode(part["counts"], _I)
            kind = np.fromiter((known.heads.get(w, -1) for w in words), _I, len(words))
            tail = np.flatnonzero(kind < 0)
            kind[tail] = np.fromiter((tail_class(words[i]) for i in tail.tolist()), _I, len(tail))
            edge = np.r_[0, np.cumsum(n)]
            sums = [_sums_between(per_word[token], edge) for per_word in (known.base(count), known.within(kind, count), count > 0)]
            ends = np.array([known.tokens[END]])
            classes = np.insert(kind[token], edge[1:], END).astype(np.uint16)
            docs = [
                {"doc_id": i, "held_out": h, "n_tokens": int(m) + 1, "n_known": int(k) + int(ends[0] > 0), "base": float(b) + float(known.base(ends)[0]), "inner": float(w)}
                for i, h, m, b, w, k in zip(row["ids"], row["held"], n.tolist(), *(s.tolist() for s in sums))
            ]
            out.append({"docs": docs, "classes": _squeezed(classes.tobytes())})
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema(
        [
            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64())]))),
            ("classes", pa.binary()),
        ]
    )
    back = totals.where("slice is not null").select("slice", "at", "counts")
    kind = "docs array<struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, inner: double>>, classes binary"
    return slices_table.drop("counts").groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(merge, kind)


def _sums_between(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of values[edge[i]:edge[i + 1]], each added up by itself."""
    out = np.zeros(len(edge) - 1)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        out[some] = np.add.reduceat(values.astype(float), edge[some])
    return out


def stream(classes: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' classes with ``CONTEXT`` start classes before each text, and the places of the tokens in it."""
    edge = np.r_[0, np.cumsum(n_tokens)]
    line = np.insert(classes.astype(_I), np.repeat(edge[:-1], CONTEXT), START)
    return line, np.arange(len(classes)) + CONTEXT * (1 + np.repeat(np.arange(len(n_tokens)), n_tokens))


class LogBilinear:
    """Class vectors r (context) and q (prediction), matrices c by distance, biases b; float32 arrays."""

    SHAPES = {"r": (CLASSES + 1, WIDTH), "c": (CONTEXT, WIDTH, WIDTH), "q": (CLASSES, WIDTH), "b": (CLASSES,)}

    def __init__(self, **arrays: np.ndarray):
        for name in self.SHAPES:
            setattr(self, name, np.ascontiguousarray(arrays[name], np.float32))

    @classmethod
    def start(cls, tokens: np.ndarray, seed: int = 11) -> LogBilinear:
        """Small random vectors; the biases are the log shares of the classes."""
        rng = np.random.default_rng(seed)
        share = (tokens + 1.0) / (tokens.sum() + len(tokens))
        return cls(r=rng.normal(0, 0.3, cls.SHAPES["r"]), c=np.stack([np.eye(WIDTH)] * CONTEXT) / CONTEXT, q=rng.normal(0, 0.3, cls.SHAPES["q"]), b=np.log(share))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES]).astype(float)

    @classmethod
    def of(cls, flat: np.ndarray) -> LogBilinear:
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES.values()])
        return cls(**{name: part.reshape(shape) for (name, shape), part in zip(cls.SHAPES.items(), np.split(flat, ends[:-1]))})

    def predicted(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Predicted vectors of the tokens at the places ``at``."""
        return sum(by_place[line[at - i - 1]] for i, by_place in enumerate(self.r @ self.c))

    def log_probs(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of each token, normalised over all classes."""
        out = np.empty(len(at))
        for s in range(0, len(at), SCORED):
            own = at[s : s + SCORED]
            z = self.predicted(line, own) @ self.q.T
            z += self.b
            most = z.max(axis=1)
            here = z[np.arange(len(own)), line[own]] - most
            z -= most[:, None]
            out[s : s + SCORED] = here - np.log(np.exp(z, out=z).sum(axis=1))
        return out

    def train(self, line: np.ndarray, at: np.ndarray, noise: np.ndarray, rng: np.random.Generator, grown: dict[str, np.ndarray]) -> None:
        """One turn of noise-contrastive steps over the tokens at ``at``, in order, by Adagrad; grown: squared gradients so far."""
        drawn = rng.choice(CLASSES, size=(-(-len(at) // BATCH), NOISE), p=noise)
        shift = np.log(NOISE * noise).astype(np.float32)
        for turn, s in enumerate(range(0, len(at), BATCH)):
            own, other = at[s : s + BATCH], drawn[turn]
            target = line[own]
            seen = [line[own - i - 1] for i in range(CONTEXT)]
            vector = sum(by_place[seen[i]] for i, by_place in enumerate(self.r @ self.c))
            # How far each label is from what the model says: the token itself is real, the noise is not.
            real = np.einsum("nd,nd->n", vector, self.q[target]) + self.b[target] - shift[target]
            real = (_sigmoid(real) - 1) / len(own)
            fake = _sigmoid(vector @ self.q[other].T + (self.b - shift)[other]) / len(own)
            pull = real[:, None] * self.q[target] + fake @ self.q[other]
            step = {"q": _rows(target, real[:, None] * vector, CLASSES), "b": np.bincount(target, real, CLASSES).astype(np.float32)}
            np.add.at(step["q"], other, fake.T @ vector)
            np.add.at(step["b"], other, fake.sum(axis=0))
            by_place = [_rows(seen[i], pull, CLASSES + 1) for i in range(CONTEXT)]
            step["r"] = sum(by_place[i] @ self.c[i].T for i in range(CONTEXT))
            step["c"] = np.stack([self.r.T @ by_place[i] for i in range(CONTEXT)])
            for name, slope in step.items():
                grown[name] += slope * slope
                getattr(self, name)[...] -= RATE * slope / np.sqrt(grown[name])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of values by key."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(own):
        out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _read(row: dict) -> tuple[list[dict], np.ndarray, np.ndarray]:
    return row["docs"], np.frombuffer(_unpacker.decompress(row["classes"]), np.uint16).astype(_I), np.array([d["n_tokens"] for d in row["docs"]], _I)


def fit_model(coded: DataFrame, tokens: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> LogBilinear:
    """The model after ``rounds`` turns over all training tokens; tokens: training tokens of each class."""
    model, noise = LogBilinear.start(tokens, seed), (tokens + 1.0) / (tokens.sum() + len(tokens))
    grown = {name: np.full(shape, 1e-6, np.float32) for name, shape in LogBilinear.SHAPES.items()}
    for turn in range(rounds if tokens.sum() else 0):
        held, before = model.flat(), {name: g.copy() for name, g in grown.items()}

        def learn(batches: Iterator[pa.RecordBatch], held=held, before=before, turn=turn) -> Iterator[pa.RecordBatch]:
            own, squares, seen = LogBilinear.of(held), {name: g.copy() for name, g in before.items()}, 0
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for batch in batches:
                for row in batch.to_pylist():
                    docs, classes, n = _read(row)
                    kept = np.array([not d["held_out"] for d in docs], bool)
                    line, at = stream(classes[np.repeat(kept, n)], n[kept])
                    own.train(line, at, noise, rng, squares)
                    seen += len(at)
            if seen:
                flat = np.concatenate([own.flat(), *(squares[name].ravel() for name in LogBilinear.SHAPES)])
                yield pa.RecordBatch.from_arrays([pa.array([np.r_[seen * flat, seen].tobytes()], pa.binary())], names=["s"])

        got = _array_sum(coded.mapInArrow(learn, "s binary"), 2 * len(held) + 1, float)
        model = LogBilinear.of(got[: len(held)] / got[-1])
        squares = LogBilinear.of(got[len(held) : -1] / got[-1])
        grown = {name: getattr(squares, name) for name in LogBilinear.SHAPES}
    return model


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each row's log10 probability by an add-one unigram model and by the log-bilinear model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; docs: doc_id, text; other columns, of any name, are
    not looked at. Rows whose crc32(doc_id as text) mod 7 is 2 are held out, as are rows without doc_id: nothing is learned from them.
    A text's tokens are its words, A-Z in lower case, and its end; null and empty texts have the end alone. Rows that
    repeat a doc_id or a text are rows of their own. Without training rows every count is 0 and the classes are as good as equally likely.
    An empty table gives an empty result.
    """
    slices_table = keep(word_slices(docs), "slices")
    totals = keep(total_counts(slices_table), "totals")
    top = totals.where("slice is null").select(F.inline("top")).orderBy(F.desc("n"), "word").limit(HEADS).collect()
    tails = _array_sum(totals.where("slice is null").select("tails"), (2, TAILS))
    texts = slices_table.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    known = ClassTable([(bytes(r.word), r.n) for r in top], tails, texts)
    coded = keep(coded_slices(slices_table, totals, known), "coded")
    model = fit_model(coded, known.tokens, rounds)
    total = known.n

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, classes, n = _read(row)
                line, at = stream(classes, n)
                outer = _sums_between(model.log_probs(line, at), np.r_[0, np.cumsum(n)]) / np.log(10)
                columns = [pa.array([d[c] for d in docs], k) for c, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()))]
                base, inner = (np.array([d[c] for d in docs]) for c in ("base", "inner"))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), total)), pa.array(base), pa.array(outer + inner)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_language_model(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
