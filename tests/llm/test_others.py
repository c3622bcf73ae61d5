import hashlib
import random
import re
import zlib
from urllib.parse import urljoin

import numpy as np
import pytest

from tests.llm import helpers as H
from tests.parity import SF, connect, same
from tracewell.llm import queries as Q
from tracewell.llm import topk_search
from tracewell.llm.decontaminate import DIMS, _answered, fit_space, item_parts, lcs_length, mark_leaks, with_leaks
from tracewell.llm.packing import WordTokenizer, cut, default_tokenizer, pack_documents
from tracewell.llm import pii
from tracewell.llm.pii import bootstrap, context_edges, count_words, find_personal_data
from tracewell.llm.quality import score_quality
from tracewell.llm.textops import distinct_words, tokenize
from tracewell.llm.topk_search import _lists, collect_and_resolve, top_k
from tracewell.llm.url_filter import filter_urls, links_of
from tracewell.llm.wrappers import align, extract_main_text, flatten, infer, main_text, match


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    same(Q.QUERIES[name](spark, SF).toPandas(), connect().execute(Q.ORACLE_SQL[name]).df())


def test_topk_ties_nulls_and_repeats(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.1, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-0.5, -0.25]), (7, [1.0, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id in (0, 9, 3)").select("vec_id"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 65536), (0, 2, 1, 32768), (0, 3, 2, 32768)]
    assert top_k(df.limit(0), df.select("vec_id")).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 17))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 7 = 0").select("vec_id"), 4).collect()}
    q = np.floor(256 * x).astype(np.int64)
    for i in range(0, 400, 7):
        best = sorted((-(q[i] @ q[j]), j) for j in range(400) if j != i)[:4]
        assert [got[(i, k + 1)] for k in range(4)] == [(j, -s) for s, j in best]


def test_topk_resolves_few_pairs():
    """Nearly all pairs go by the cutoff alone; the rest equal brute force."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(2000, 64)))
    q = x[:40]
    score = (q @ x.T).astype(np.int64)
    allowed = np.arange(40)[:, None] != np.arange(2000)[None, :]
    cutoff = np.sort(np.where(allowed, score, -(2**62)), axis=1)[:, -5]
    at, col, got, looked = collect_and_resolve(q, x, _lists(64, 4), cutoff, allowed)
    want = np.nonzero(allowed & (score >= cutoff[:, None]))
    assert set(zip(at.tolist(), col.tolist(), got.tolist())) == set(zip(want[0].tolist(), want[1].tolist(), score[want].tolist()))
    assert looked < 0.4 * score.size
    everything = collect_and_resolve(q, x[:3], _lists(64, 4), np.full(40, np.iinfo(np.int64).min), allowed[:, :3])
    assert len(everything[0]) == allowed[:, :3].sum()


def test_topk_groups_and_other_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist(), "e", 1, "d") for i, v in enumerate(x)], "vec_id long, v array<double>, embedding string, dim int, data string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk_search, "ROW_BLOCK", 16), m.setattr(topk_search, "QUERY_BLOCK", 8), m.setattr(topk_search, "GROUP_ROWS", 3), m.setattr(topk_search, "GROUP_QUERIES", 2)
        got = {(r.query_id, r.rank): r.vec_id for r in top_k(df, df.where("vec_id % 3 = 0").select("vec_id"), 2, vec="v").collect()}
    y = np.floor(256 * x).astype(np.int64)
    want = {(i, k + 1): sorted((-(y[i] @ y[j]), j) for j in range(300) if j != i)[k][1] for i in range(0, 300, 3) for k in range(2)}
    assert got == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def test_pii_base(spark):
    texts = [None, "", "a@b.cc x_y@d.ee.f_z@g.hh", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (389) 555-5010, +1 2 +49 30 123456789012345", "ñé😀 a@b.cd 😀 1.2.3.4", "x" * 50000 + "@" + "1" * 3000, "12 3 4111111111111111 5" * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[3]), (2, texts[2])]
    got = find_personal_data(H.docs(spark, rows, extra=True)).collect()
    assert sorted((r.doc_id, r.base) for r in got) == sorted((i, base(t)) for i, t in rows)
    assert all(r.spans[: len(r.base)] == r.base for r in got)
    assert find_personal_data(H.docs(spark, [])).count() == 0


def test_pii_bootstrap(spark):
    seeds = [(f"card{i}", "card:", True) for i in range(5)] + [("unseen1", "card:", False), ("other", "version", False)]
    got = [r.token for r in bootstrap(context_edges(spark.createDataFrame(seeds, "token string, context string, seed boolean"))).collect()]
    assert got == ["unseen1"]
    rows = [(i, f"my card: {n} thanks") for i, n in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222222220"[:16]])] + [(9, "my card: 4111111111111112 thanks"), (10, "version 1234567 of")]
    spans = {r.doc_id: r.spans for r in find_personal_data(H.docs(spark, rows)).collect()}
    assert spans[9] == ["id:9:25"] and spans[10] == []


def test_pii_seeds_of_all_kinds_and_common_words(spark):
    phones = [(i, f"call line +1 (017) 555-77{i}0 today") for i in range(10, 16)] + [(20, "call line +1 (017) 555 today"), (21, "the +1 (017) 556 x")]
    mails = [(30 + i, f"write to mailbox: u{i}@d.ee soon") for i in range(6)] + [(40, "write to mailbox: root@local soon")]
    cards = [(50 + i, f"the {n} is") for i, n in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005000"])] + [(60, "the 12 is"), (61, "the a the b the c is is is the d " * 20)]
    odd = [(None, "write to mailbox: root@local soon"), (70, None), (71, "")]
    spans = {r.doc_id: r.spans for r in find_personal_data(H.docs(spark, phones + mails + cards + odd)).collect()}
    assert spans[40] == spans[None] == ["id:18:28"]
    assert spans[60] == spans[61] == spans[70] == spans[71] == []
    assert all(x.split(":")[0] != "id" for i in (*range(10, 16), *range(30, 36), *range(50, 54)) for x in spans[i])


@pytest.mark.parametrize("most", [0, 10**6])
def test_pii_counts_of_context_words(spark, monkeypatch, most):
    """Words asked for are counted alike whether they are broadcast or met after all words were counted."""
    monkeypatch.setattr(pii, "ASKED_BYTES", most)
    rows = [(1, "the Card: 12 THE card"), (2, None), (3, ""), (None, "card the, x"), (1, "the Card: 12 THE card")]
    docs = H.docs(spark, rows).selectExpr("doc_id", "coalesce(text, '') as text")
    asked = spark.createDataFrame([("the",), ("card:",), ("never",)], "word string")
    assert {r.word: r.n for r in count_words(docs, asked).collect()} == {"the": 5, "card:": 2}


def test_pii_discovery_on_a_generated_table(spark):
    """Precision and recall of identifiers that no base pattern takes, over a table in which the same shapes also stand after common words.

    Accounts stand after telling words and are, like the numbers of known cards, 16 digits; half of them fail the checksum, so only their context tells
    them. Order numbers of the same shape stand after words that say nothing.
    """
    r = random.Random(5)

    def number(good):
        while True:
            n = "".join(r.choice("0123456789") for _ in range(16))
            if (sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(n)) % 10 == 0) == good:
                return n

    filler = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 6
    words = lambda k: " ".join(r.choice(filler) for _ in range(k))
    rows, want, others = [], set(), set()
    for i in range(1200):
        kind = r.choice(["seed", "unseen", "order", "plain"])
        n = number(kind == "seed") if kind != "plain" else ""
        before = r.choice(["account:", "konto:", "iban="]) if kind in ("seed", "unseen") else r.choice(["the", "of", "w7"])
        lead = f"{words(r.randrange(1, 30))} {before} "
        rows.append((i, f"{lead}{n} {words(5)}" if n else words(20)))
        if kind == "unseen":
            want.add((i, f"id:{len(lead)}:{len(lead) + 16}"))
        elif kind == "order":
            others.add(i)
    got = {(x.doc_id, s) for x in find_personal_data(H.docs(spark, rows)).collect() for s in x.spans if s.startswith("id:")}
    assert len(want) > 200 and len(others) > 200
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_pii_positions_of_many_matches(spark):
    text = "é 1.2.3.4 a@b.cc +49 30 1234567 x 4111111111111111 " * 700
    (got,) = find_personal_data(H.docs(spark, [(1, text)])).collect()
    assert got.base == base(text)


def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.org/x", link.format("http://www.example.com/fr/1")),
        (2, "http://b.org/y", '<meta http-equiv="refresh" content="0; url=http://example.com/en/9">'),
        (3, "http://c.org/z#top", link.format("http://b.org/y")),
        (4, "http://www.example.com/en/1", link.format("http://b.org/y")),
        (5, "HTTP://X.Net/es/1", ""),
        (6, None, None),
        (7, "nothing", "<p>"),
        (8, "http://c.org/z", None),
        (8, "http://c.org/z", None),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, alias string")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in filter_urls(df).na.fill("-", ["rule"]).collect())
    assert got == [
        (1, "a.org", "-", "allow"),
        (2, "b.org", "-", "block"),
        (3, "c.org", "-", "block"),
        (4, "www.example.com", "www.example.com/en/", "allow"),
        (5, "x.net", "net/es/", "block"),
        (6, "", "-", "allow"),
        (7, "", "-", "allow"),
        (8, "c.org", "-", "block"),
        (8, "c.org", "-", "block"),
    ]
    assert filter_urls(df.limit(0)).count() == 0


def test_url_links_of_all_forms(spark):
    """Against urljoin: every reference form, attribute order and number of links."""
    url = "http://a.org/d/e/f.html?q=1"
    forms = ["page2.html", "?id=3", "../x", "../../../x/./y/..", "./", "..", "/r", "/go?u=http://other.org/z", "//b.org/y", "http://c.org/z", "g?y=a/../b", "g;x=1/./y"]
    shapes = ['<link rel="canonical" href="{}">', "<LINK HREF='{}' REL=canonical>", '<meta content="0; url={}" http-equiv="refresh">', """<meta http-equiv=refresh content="5;URL='{}'">"""]
    rows = [(url, "<p>x</p>".join(s.format(t) for t in forms)) for s in shapes]
    rows += [(url, '<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="#top"><link rel="stylesheet" href="s.css">'), ("http://a.org", '<link rel="canonical" href="x">')]
    got = [(r.url, r.target) for r in links_of(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == sorted([(url, urljoin(url, t)) for _ in shapes for t in forms] + [("http://a.org", "http://a.org/x")])
    pages = [(1, "http://a.org/d/1", '<link rel="canonical" href="2"><link rel="canonical" href="3">'), (2, "http://a.org/d/3", '<meta content="0;url=//x.net/es/1" http-equiv="refresh">'), (3, "http://a.org/d/2", ""), (4, "http://b.org/", '<link rel="canonical" href="/go?u=http://x.net/es/1">')]
    verdicts = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow"}


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul>{nav}</ul></nav><div class='ad'>buy</div><article><h1>Head</h1>{body}</article><div id=comments><p>troll</p></div><footer>&copy; x</footer></body></html>"


def test_main_text():
    page = PAGE.replace("{nav}", "<li><a href=x>m</a></li>").replace("{body}", "<p><b>One &amp;\n two<br><p>Three<!-- <p>no --></p><script>var t='</p>';</script><p> </p><ul><li>a<li>b</ul>")
    assert main_text(page) == "Head\n\nOne & two\n\nThree\n\na\n\nb"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<div>shared</div><div>own</div>", infer(["<div>shared</div><div>a</div>", "<div>shared</div><div>b</div>"])) == "own"
    assert main_text("a < b <") == "a < b <"
    assert main_text("<p>" + "x " * 100_000) == ("x " * 100_000).strip()


def test_wrapper_alignment():
    a = flatten("<ul><li>a</li><li>b</li></ul><p>x</p>")
    b = flatten("<ul><li>a</li><li>b</li><li>c</li><li>d</li></ul><i>new</i><p>y</p>")
    w = align([["t", t] for t in a], b)
    kinds = [x[0] for x in w]
    assert "rep" in kinds and "opt" in kinds and ["slot"] in w
    again = align(w, b)
    assert [x for x in again if x[0] != "slot"] == [x for x in w if x[0] != "slot"]


def test_pages(spark):
    shared = "<div>Welcome to the site</div>"
    rows = [(i, f"http://h.org/{i}", f"{shared}<div>text {i}</div>") for i in range(4)] + [(9, None, None), (9, "http://h.org/9", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect()}
    assert got == {(i, f"text {i}", 6) for i in range(4)} | {(9, "", 0)}
    assert extract_main_text(df.limit(0)).count() == 0


def site(r, k):
    """(html, main text) of a page whose boilerplate no name gives away; long frames, repeated and optional parts."""
    paras = [" ".join(f"p{r.randrange(900)}" for _ in range(r.randrange(3, 30))) for _ in range(r.randrange(1, 12))]
    rail = "".join(f"<div class=c1><span>Box {i}</span></div>" for i in range(300))
    extra = f"<div class=c5>Only {k}</div>" if k % 3 == 0 else ""
    body = "".join(f"<div class=c2>{p}</div>" for p in paras)
    html = f"<html><body><div class=c0>Site name</div>{rail}<div class=c3>{extra}{body}</div><div class=c4>All rights</div><div class=c4>Since 1999</div></body></html>"
    return html, "\n\n".join(([f"Only {k}"] if extra else []) + paras)


@pytest.mark.parametrize("bound", [16_000_000, 0])
def test_wrappers_decide(spark, bound):
    """Frames over 600 tokens long, two templates of one host; without wrappers the frame stays in."""
    r = random.Random(5)
    made = [site(r, k) for k in range(25)]
    rows = [(k, f"http://s.org/{k}", h) for k, (h, _) in enumerate(made)]
    other = [(100 + k, f"http://s.org/o{k}", f"<html><body><p class=x>Hello</p><table><tr><td>cell {k}</td></tr></table></body></html>") for k in range(3)]
    got = {x.page_id: x.text for x in extract_main_text(spark.createDataFrame(rows + other, "page_id long, url string, html string"), broadcast_bytes=bound).collect()}
    assert got == {k: t for k, (_, t) in enumerate(made)} | {100 + k: f"cell {k}" for k in range(3)}
    assert all(main_text(h) != t for h, t in made)


@pytest.mark.parametrize("bound", [16_000_000, 0])
def test_every_page_decides_on_literals(spark, bound):
    """A text on which the samples agree is no frame if one of the other pages holds another text there."""
    odd = lambda h, k: f"Only {h}" if k == h else "Same"
    rows = [(100 * h + k, f"http://h{h}.org/{k}", f"<p>Site</p><div>{odd(h, k)}</div><div>own {k}</div>") for h in range(12) for k in range(30)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=bound).collect()}
    assert got == {100 * h + k: f"{odd(h, k)}\n\nown {k}" for h in range(12) for k in range(30)}


def test_wrapper_fits_its_pages():
    """Every page is in the language of the wrapper that it helped to infer: a brute-force matcher consumes it whole."""
    def ends(items, page, at):
        found = {at}
        for item in items:
            nxt = set()
            for a in found:
                if item[0] == "t":
                    nxt |= {a + 1} if a < len(page) and page[a] == item[1] else set()
                elif item[0] == "slot":
                    nxt |= {a} | ({a + 1} if a < len(page) and page[a][0] == "=" else set())
                else:
                    nxt.add(a)
                    more = ends(item[1], page, a) - nxt
                    while more:
                        nxt |= more
                        more = {e for m in more for e in ends(item[1], page, m)} - nxt if item[0] == "rep" else set()
            found = nxt
        return found

    r = random.Random(9)
    for _ in range(40):
        pages = ["<div>Top</div>" + "".join(f"<p>{r.randrange(9)}</p>" for _ in range(r.randrange(4))) + ("<i>x</i>" if r.random() < 0.5 else "") + f"<b>{r.randrange(3)}</b>" for _ in range(4)]
        wrapper = infer(pages)
        for page in pages if wrapper else []:
            flat = flatten(page)
            assert len(flat) in ends(wrapper, flat, 0)
            assert len(match(wrapper, flat)) == sum(t[0] == "=" for t in flat)


def test_pages_of_copies(spark):
    """Copies and repeated rows fill no samples and make no frame."""
    page = "<div>Welcome</div><div>own {}</div>"
    rows = [(1, "http://twice.org/1", page.format(1))] * 2 + [(2, "http://twice.org/2", page.format(1) + "<!-- copy -->")]
    rows += [(100 + i, f"http://many.org/{i}", page.format(7)) for i in range(200)] + [(300 + i, f"http://many.org/x{i}", page.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Welcome\n\nown 1", 2: "Welcome\n\nown 1"} | {100 + i: "own 7" for i in range(200)} | {300 + i: f"own {i}" for i in range(3)}


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    texts = [None, "", "Hello, WORLD!! it's 42", "ΑΣ Å é́ ß", "x <|endoftext|> y", "  a b", "a." * 3000, H.prose(4000, 1), "don't. can't! U.S.A... e.g.,", "𝔘𝔫𝔦 <|ENDOFTEXT|>"]
    rows = list(enumerate(texts)) + [(1, "again"), (None, "none")]
    df = H.docs(spark, rows, extra=True).coalesce(2)
    got = pack_documents(df, default_tokenizer(), with_ids=True).collect()
    want = {(i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows}
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    assert {(k[0], b"".join(x for _, x in sorted(v))) for k, v in by.items()} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at > 1900 or at & (at - 1) == 0)
    assert pack_documents(df.limit(0), default_tokenizer()).count() == 0


ODD_TEXTS = ["don't, can't.. I'LL", "ÀÉ Ǆ ǅ ΑΣ σΣ. İstanbul, ﬁ é, é à.. x̸< ≮", "  ", "１２ ½, ab…, ab…x naïve$$$ 3.5% a'd'$$ <| a|>   x y z \x1c\x1d k\x85k", "日本語。テスト, ça!? Ÿ ẞ K Å", "a <|startoftext|>b"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_stand_for_texts(file):
    import public_tokenizers

    words = WordTokenizer(public_tokenizers.path(file))
    assert words.by_word == (file == "word_bpe_49k.json")
    texts = ODD_TEXTS + [None, ""] + [H.prose(300, i).replace("w1", "W1. ").replace("w2", "é!? ") for i in range(5)]
    for _ in range(3):  # the memory, its second half and its loss change nothing
        for t, raw in zip(texts, words.ids(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == words.plain.encode(t or "", add_special_tokens=False).ids
        words.known, words.older = {}, words.known


def test_distinct_words_with_equal_hashes():
    found = tokenize(["a bb a ccc bb", "ccc dddddddddddd dddddddddddx"])
    found.hashes[:] = 7
    first, of = distinct_words(found)
    name = lambda i: found.raw[found.starts[i] : found.ends[i]]
    assert [name(first[k]) for k in of] == [name(i) for i in range(len(of))] and len(first) == 5


def test_cut():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        assert sum(cut(n)) == n and max(cut(n)) <= 2048


def test_quality(spark):
    good = [(i, H.prose(80, i)) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in H.prose(80, 1000 + i).split())) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:40]] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = good + bad + [(2000, None), (2001, ""), (None, "x y"), (2002, "word " * 50_000)]
    got = {r.doc_id: r for r in score_quality(H.docs(spark, rows, extra=True), labels).collect()}
    held = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    held = [(i, y) for i, y in held if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    assert score_quality(H.docs(spark, []), labels).count() == 0
    assert score_quality(H.docs(spark, good[:3]), labels.limit(0)).select("score").distinct().count() == 1


def test_lcs():
    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("aaa", "aa")):
        x, y = [c.encode() for c in a], [c.encode() for c in b]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(x, y) == t[-1][-1]


def test_leaks(spark):
    items = [(k, H.prose(40, 500 + k, 4000)) for k in range(20)]
    para = items[3][1].split()
    para[2::6] = ["swapped"] * len(para[2::6])
    rows = [(i, H.prose(200, i, 4000)) for i in range(60)]
    rows[7] = (7, rows[7][1] + "\n" + items[0][1].upper() + ", " + rows[8][1])
    rows[9] = (9, " ".join(para) + " " + rows[9][1])
    rows[11] = (11, " ".join(items[5][1].split()[:15]) + " " + rows[11][1])
    rows += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (None, items[1][1])]
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "x")], "item_id long, text string")
    got = {r.doc_id: r for r in mark_leaks(H.docs(spark, rows, extra=True), bench).collect()}
    assert {i: list(r["items"]) for i, r in got.items() if r.contaminated} == {7: [0], 9: [3], 102: [1], None: [1]}
    assert mark_leaks(H.docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert mark_leaks(H.docs(spark, []), bench).count() == 0


def test_leaks_against_brute_force(spark):
    """Recall over all windows of twice an item's words, with long items, short ones and a very long text."""
    r = random.Random(8)
    items = [(k, H.prose(n, 900 + k, 3000)) for k, n in enumerate([5, 8, 12, 16, 20, 31, 33, 47, 64, 64, 65, 80, 130, 40, 25, 18])]
    rows = [(i, H.prose(r.randrange(1, 400), i, 3000)) for i in range(300)] + [(900, H.prose(60_000, 77, 3000))]
    for i in range(0, 300, 3):
        k = r.randrange(len(items))
        w = [x if r.random() > 0.02 * (i % 20) else "other" for x in items[k][1].split()]
        at = r.randrange(100)
        rows[i] = (i, " ".join(rows[i][1].split()[:at] + w + rows[i][1].split()[at:]))
    rows[-1] = (900, rows[-1][1][:200_000] + " " + items[9][1] + " " + rows[-1][1][200_000:])

    def holds(text, item):
        for s in range(0, max(1, len(item)), 64):
            part = item[max(0, len(item) - 64) if s and len(item) - s < 64 else s :][:64]
            if not {*part} & {*text} or sum(w in set(text) for w in part) < 0.5 * len(part):
                continue
            for a in range(0, max(1, len(text) - len(part)), max(1, len(part) // 4)):
                near = text[a : a + 2 * len(part)]
                share = lcs_length(near, part) / len(part)
                if share >= 0.7 or share >= 0.5 and _answered(near, part):
                    return True
        return False

    want = {(i, k) for i, t in rows for k, x in items if holds(t.split(), x.split())}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, k) for x in mark_leaks(H.docs(spark, rows), bench).collect() for k in x["items"]}
    assert len(got & want) >= 0.95 * len(want) and (900, 9) in got
    for i, k in got - want:  # wider windows than those of the brute force may hold a little more
        assert lcs_length(dict(rows)[i].split(), dict(items)[k].split()[:64]) >= 3


def test_paraphrase_by_words_that_keep_company(spark):
    """Words of a passage that the item does not have count where the corpus uses them as the item's own."""
    r = random.Random(1)
    pairs = [(f"left{i}", f"right{i}") for i in range(20)]
    rows = [(100 + i, " ".join(x for p in r.sample(pairs, 4) for x in p) + " " + H.prose(16, i, 5000)) for i in range(1500)]
    item = " ".join(a for a, _ in pairs)
    # Half of the words are the item's, the answer among them.
    para = " ".join(a if i % 2 == 0 or i >= 16 else b for i, (a, b) in enumerate(pairs))
    docs, bench = H.docs(spark, [*rows, (1000, para)]), spark.createDataFrame([(1, item)], "item_id long, text string")
    parts = item_parts(bench)
    space = fit_space(docs.select("text"), [h for _, h in parts], 32)

    def cosine(axes):
        place = lambda t: axes[[int(x) % DIMS for x in tokenize([t]).hashes]].sum(0)
        x, y = place(para), place(item)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    lexical = sum(a in para.split() for a, _ in pairs) / len(pairs)
    assert cosine(space.axes) > lexical + 0.2
    got = {x.doc_id: x["items"] for x in with_leaks(docs, bench, 32, cover=0.8).selectExpr("doc_id", "transform(leaks, x -> x.item_id) as items").collect()}
    assert got[1000] == [1]


def test_latent_space_comes_in_slices(spark, monkeypatch):
    """Nothing large reaches the driver as one value, and the slices make up the whole matrix."""
    r = random.Random(3)
    docs = H.docs(spark, [(i, " ".join(f"w{i % 8 * 100 + r.randrange(40)}" for _ in range(32))) for i in range(300)])  # eight topics
    sizes, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: [sizes.extend(len(v) for v in x if isinstance(v, (bytes, bytearray))) or x for x in collect(self)])
    space = fit_space(docs.select("text"), [], 64)
    assert max(sizes) <= 256 * 1024
    hashes = [tokenize([x.text]).hashes for x in collect(docs)]
    tf = np.stack([np.bincount((h % np.uint64(DIMS)).astype(int), minlength=DIMS) for h in hashes]).astype(float)
    idf = np.log((len(tf) + 2) / (tf.sum(0) + 1)).clip(0.05)
    x = tf * idf
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(space.values[:8], exact[:8], rtol=1e-3)
    assert ((np.abs(space.axes[:-1]).sum(1) > 1e-6) == (tf.sum(0) > 0)).mean() > 0.999


def test_leaks_among_common_words(spark):
    """Words outside the items must not hide a paraphrase, however many there are."""
    items = [(k, H.prose(40, 5000 + k, 150)) for k in range(5)]
    rows = [(i, H.prose(120, i, 150)) for i in range(1500)]
    for k, text in items:
        para = [f"other{k}x{i}" if i % 10 in (2, 5, 8) else w for i, w in enumerate(text.split())]
        rows[k] = (k, " ".join(f"strange{k}x{i}" for i in range(50)) + " " + " ".join(para) + " " + " ".join(f"late{k}x{i}" for i in range(50)))
    got = {r.doc_id: (list(r["items"]), r.share) for r in mark_leaks(H.docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert got == {k: ([k], 0.7) for k, _ in items}


def test_whole_table_hash(spark):
    got = Q.QUERIES["op2_substring_dedup"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in H.substring(list(zip(docs.doc_id, docs.text)))}
    assert set(map(tuple, got[["doc_id", "n_words", "n_removed", "kept_sha256"]].values)) == want


