"""Personal data by patterns and bootstrapped contexts (operator 4), DataFrame functions only.

Base: four fixed patterns with checks. Bootstrapping: every base span is a seed; candidates are
runs of tokens with a digit or ``@`` whose shape (runs of digits and of name characters folded) some
seeds have, of any length. Instances and their contexts, the word before and the word after,
form a graph. A context's confidence is the share of all occurrences of its word in the corpus that stand
at a seed or a candidate, so that common words tell nothing. It passes it on if it has enough trusted instances, and if they
are a fair share of what it stands at; a candidate takes the noisy-or of its contexts. After a few rounds, confident
candidates become spans of kind ``id``. Each round is two aggregations over (context, instance)
counts, so a common context moves as partial sums.

Positions are code points. Spark has no function for all match positions; a match starts where
the pieces that ``split`` leaves before it and the matches before it end. The patterns hold
lookbehinds and possessive runs: they find the same leftmost matches in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import keep

_WS = r"\x20\x09-\x0D"
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must contain for a pattern to be tried.
_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Tokens with a digit or @ and the numbers that follow them, one match per run.
_TOKEN = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+(?:\x20[(]?[0-9][0-9().-]*+(?=[{_WS}.,;:!?]|$))*+"
#: Trusted instances of a context, their share of its instances, its confidence, and the trust of an instance, at least.
ROUNDS, SUPPORT, SHARE, CONTEXT, INSTANCE = 3, 3, 0.2, 0.6, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Context words are broadcast up to so many bytes.
ASKED_BYTES = 8_000_000
#: Prefix sums are taken over blocks of so many matches.
_BLOCK = 512


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(x))
    if kind == "card":
        return n.between(16, 19) & F.coalesce(F.call_function("luhn_check", _digits(x)), F.lit(False))
    return n.between(8, 15)


def _indexes(matches: str, good) -> Column:
    """Positions in the array of the matches that are good."""
    return F.filter(F.transform(matches, lambda x, i: F.when(good(x), i)), lambda i: i.isNotNull())


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _steps(pieces: str, matches: str) -> Column:
    """Code points of each piece and the match after it."""
    return F.zip_with(F.transform(pieces, F.length), F.transform(matches, F.length), lambda g, n: F.coalesce(g, F.lit(0)) + F.coalesce(n, F.lit(0)))


def _blocks(steps: str) -> Column:
    """Sum of each whole block of ``steps``."""
    whole = F.floor(F.size(steps) / _BLOCK).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, _BLOCK)))).otherwise(F.array().cast("array<int>"))


def _end(kind: str, i: Column) -> Column:
    """End of match i: whole blocks before it, then the steps of its own block."""
    b = F.floor((i + 1) / _BLOCK).cast("int")
    return _sum(F.slice(f"b_{kind}", F.lit(1), b)) + _sum(F.slice(f"g_{kind}", b * _BLOCK + 1, i + 1 - b * _BLOCK))


def context_word(x: Column) -> Column:
    """Letters and a few signs of a word, A-Z lower-cased: the form in which words are contexts and are counted."""
    return F.regexp_replace(F.translate(x, _UPPER, _LOWER), rf"[^\p{{L}}=:#{_WS}]+", "")


def _contexts(before: Column, after: Column) -> Column:
    """Last word of the piece before and first word of the piece after, marked by side; empty ones are left out."""
    plain = lambda x: F.translate(x, "\t\n\x0b\x0c\r", "     ")
    left = context_word(F.substring_index(F.rtrim(plain(before)), " ", -1))
    right = context_word(F.substring_index(F.regexp_replace(plain(after), r"^[\x20.,;)\]]++", ""), " ", 1))
    return F.filter(F.array(F.concat(F.lit("<"), left), F.concat(F.lit(">"), right)), lambda c: F.length(c) > 1)


def shape(x: Column) -> Column:
    """A token with each run that holds a letter (dots and the like included) as a and each other run of digits as 9."""
    return F.regexp_replace(F.regexp_replace(x, r"(?<![0-9._%+-])[0-9._%+-]*+\p{L}[\p{L}0-9._%+-]*+", "a"), "[0-9]++", "9")


def _list(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x.s, x.e))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds spans_<kind> (array of s, e) for each kind, seeds (token, contexts) and tokens (token, s, e, contexts) to doc_id, text."""
    none = F.array().cast("array<string>")
    every = PATTERNS | {"token": _TOKEN}
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.contains("text", F.lit("@"))
    when = {k: has_digit & F.contains("text", F.lit(_SIGN[k])) for k in KINDS} | {"email": has_at, "token": has_digit | has_at}
    docs = docs.withColumns({f"m_{k}": F.when(when[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in every.items()})
    core = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^A-Za-z0-9+]++", ""), r"[^A-Za-z0-9]+$", "")
    good = {k: lambda x, k=k: _passes(k, x) for k in KINDS} | {"token": lambda x: F.length(core(x)) > 0}
    docs = docs.withColumns({f"i_{k}": _indexes(f"m_{k}", good[k]) for k in every})
    docs = docs.withColumns({f"p_{k}": F.when(F.size(f"i_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in every.items()})
    docs = docs.withColumns({f"g_{k}": _steps(f"p_{k}", f"m_{k}") for k in every})
    docs = docs.withColumns({f"b_{k}": _blocks(f"g_{k}") for k in every})
    match = lambda k, i: F.element_at(f"m_{k}", i + 1)
    around = lambda k, i: _contexts(F.element_at(f"p_{k}", i + 1), F.element_at(f"p_{k}", i + 2)).alias("contexts")

    def span(k: str, i: Column) -> Column:
        return F.struct((_end(k, i) - F.length(match(k, i))).alias("s"), _end(k, i).alias("e"))

    def token(i: Column) -> Column:
        whole, end = match("token", i), _end("token", i)
        s = end - F.length(F.regexp_replace(whole, r"^[^A-Za-z0-9+]++", ""))
        return F.struct(core(whole).alias("token"), s.alias("s"), (s + F.length(core(whole))).alias("e"), around("token", i))

    def seed(k: str, i: Column) -> Column:
        return F.struct(match(k, i).alias("token"), around(k, i))

    each = lambda k, f: F.transform(f"i_{k}", lambda i: f(k, i))
    seeds = F.concat(*(each(k, seed) for k in KINDS))
    spans = {f"spans_{k}": each(k, span) for k in KINDS}
    return docs.withColumns(spans | {"seeds": seeds, "tokens": F.transform("i_token", token)}).select("doc_id", "text", *spans, "seeds", "tokens")


def count_words(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Occurrences in all texts of the context words asked for: word, n.

    Words asked for are met before anything is counted; only if they take more than ``ASKED_BYTES`` all words are counted and then met.
    """
    words = docs.select(F.explode(F.split(context_word(F.col("text")), rf"[{_WS}]+")).alias("word")).where("word <> ''")
    size = asked.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if size <= ASKED_BYTES:
        words = words.join(F.broadcast(asked), "word", "left_semi")
        return words.groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy("word").agg(F.count("*").alias("n")).join(asked, "word", "left_semi")


def context_edges(occurrences: DataFrame) -> DataFrame:
    """(token, context, w, seed): how often they occur together and whether the token is a seed, from (token, context, seed) occurrences."""
    return occurrences.where("token <> '' and context <> ''").groupBy("token", "context").agg(F.count("*").alias("w"), F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, overall: DataFrame | None = None) -> DataFrame:
    """Confident instances outside the seeds: (token, score), from a written table of ``context_edges``.

    overall: context, n (occurrences of the context with or without an instance); by default only those given count.
    """
    seeds = edges.groupBy("token").agg(F.max("seed").alias("seed")).where("seed").select("token", F.lit(1.0).alias("trust"))
    uses = edges.groupBy("context").agg(F.sum("w").alias("w"))
    if overall is not None:
        uses = uses.join(overall, "context", "left").select("context", F.greatest("w", F.coalesce("n", F.lit(0))).alias("w"))
    uses = keep(edges.groupBy("context").agg(F.sum("w").alias("at")).join(uses.withColumnRenamed("w", "uses"), "context"), "uses")
    trust = keep(seeds, "trust")
    for turn in range(rounds):
        known = edges.drop("seed").join(trust, "token")
        contexts = known.groupBy("context").agg(F.sum(F.col("trust") * F.col("w")).alias("sure"), F.sum((F.col("trust") >= INSTANCE).cast("int")).alias("support"))
        contexts = contexts.where(F.col("support") >= SUPPORT).join(uses, "context").where(F.col("sure") >= SHARE * F.col("at"))
        contexts = contexts.select("context", (F.col("at") / F.col("uses")).alias("conf")).where(F.col("conf") >= CONTEXT)
        # noisy-or: 1 - prod(1 - conf)
        told = edges.join(contexts, "context").groupBy("token").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.99)))))).alias("trust"))
        trust = keep(seeds.unionByName(told.join(seeds.select("token"), "token", "left_anti")), f"trust-{turn}")
    return trust.join(seeds.select("token"), "token", "left_anti").where(F.col("trust") >= INSTANCE).select("token", F.col("trust").alias("score"))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone, n_id, base (list), spans (list).

    docs: doc_id, text. One row per input row; null and empty texts have no spans. Spans are kind:start:end in
    code points, end exclusive, by kind (email, ip, card, phone, then id) and start. The base does not
    depend on other rows; discovered ``id`` spans never overlap base spans. Rows with a null doc_id count like others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base_spans(docs)
    base = F.concat(*(F.col(f"spans_{k}") for k in KINDS))
    touches = lambda t: F.exists(base, lambda b: (b.s < t.e) & (b.e > t.s))
    # Equal texts find equal spans, so a hash of the text, with the id, stands for a row.
    found = found.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("version"), *(f"spans_{k}" for k in KINDS), "seeds", F.filter("tokens", lambda t: ~touches(t)).alias("tokens"))
    found = keep(found, "base")
    seeds = found.select(F.explode("seeds").alias("t")).select("t.token", "t.contexts", F.lit(True).alias("seed"))
    shapes = seeds.groupBy(shape(F.col("token")).alias("shape")).agg(F.countDistinct("token").alias("n")).where(F.col("n") >= SUPPORT)
    seen = found.where(F.size("tokens") > 0).select("key", "version", F.explode("tokens").alias("t")).select("key", "version", "t.*")
    seen = seen.join(shapes.withColumnRenamed("shape", "_shape"), shape(F.col("token")) == F.col("_shape"), "left_semi")
    uses = seeds.unionByName(seen.select("token", "contexts", F.lit(False).alias("seed"))).select("token", F.explode("contexts").alias("context"), "seed")
    edges = keep(context_edges(uses), "edges")
    asked = keep(edges.select(F.substring("context", 2, 2**31 - 1).alias("word")).distinct(), "asked")
    overall = count_words(docs, asked).select(F.explode(F.array(F.concat(F.lit("<"), "word"), F.concat(F.lit(">"), "word"))).alias("context"), "n")
    new = bootstrap(edges, rounds, overall)
    extra = seen.join(new.select("token"), "token").groupBy("key", "version").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans_id"))
    out = found.drop("seeds", "tokens").join(extra, ["key", "version"], "left").withColumn("spans_id", F.coalesce("spans_id", F.array().cast("array<struct<s:int,e:int>>")))
    lists = {k: _list(k, F.col(f"spans_{k}")) for k in (*KINDS, "id")}
    return out.select(
        "doc_id",
        *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, "id")),
        F.concat(*(lists[k] for k in KINDS)).alias("base"),
        F.concat(*lists.values()).alias("spans"),
    )


def op4_pii(spark, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), "n_id")
