"""Pages, pieces, packing, rules, personal data and mixing on odd rows, against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest

from skytrace.llm import mixing, packing, page_text, personal_data, pieces, quality_rules, textbytes
from skytrace.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


def test_word_hashes():
    texts = ["Hello world hello\tWORLD é", None, "", "   ", "a  b" * 3, "x" * 3_000_000 + " y " + "x" * 3_000_000, "z"]
    got, first = textbytes.word_hashes(pa.array(texts))
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert len({(w, int(h)) for w, h in zip(flat, got, strict=True)}) == len(set(flat)) == len(set(got.tolist()))


def test_page_text(spark):
    menu = "<nav><a href=x>Home</a></nav><div class='share-bar'>Share this</div>"
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{menu}<div><p>Standing line.</p>{body}</div><footer>f</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page(f"<h1>Title {i}</h1><p>Text &amp; more\n of <b>page</b> {i}<p>Second {i}")) for i in range(12)]
    rows += [(50, None, "<p>a<br>b</p><form>no</form>tail"), (51, "http://x/", None), (52, "http://x/", ""), (52, "http://x/", ""), (53, "u", "<div>" * 5000 + "deep"), (None, None, "<<&amp")]
    got = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[3] == "Title 3\nText & more of page 3\nSecond 3"  # the standing line is template
    assert text[50] == "a b\ntail" and text[51] == text[52] == "" and text[53] == "deep"
    assert page_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_same_article_with_other_menus(spark):
    page = lambda menu, body: f"<html><body><nav>{menu}</nav><article>{body}<p>Terms apply</p></article></body></html>"
    own = "<p>First part</p><p>Second part</p>"
    rows = [(i, f"http://one.org/{i}", page(f"menu {i}", own)) for i in range(30)]
    rows += [(30 + i, f"http://two.org/{i}", page("menu", f"<p>story {i}</p><p>more {i}</p>")) for i in range(12)]
    got = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = {r["page_id"]: r["text"] for r in got}
    assert {found[i] for i in range(30)} == {"First part\nSecond part\nTerms apply"}
    assert all(found[30 + i] == f"story {i}\nmore {i}" for i in range(12))


def test_hidden_parts_stay_hidden_at_any_depth():
    def shown(node):
        return [] if node.hidden else [node.text] * bool(node.text) + [t for k in node.kids for t in shown(k)]

    inner = "<nav><ul><li>one<li>two</ul><div>three</div>tail</nav><p>article</p>"
    for depth in (0, 10, page_text.DEEPEST - 2, page_text.DEEPEST - 1, page_text.DEEPEST, page_text.DEEPEST + 60):
        assert shown(page_text.parse("<div>" * depth + inner + "</div>" * depth + "<p>end</p>")) == ["article", "end"]
        assert shown(page_text.parse("<div><nav>" + "<div>" * depth + "menu" + "</div>" * depth + "more</nav><p>end</p></div>")) == ["end"]


def test_tree_matching_is_the_largest():
    a = page_text.parse("<ul><li>a</li><li>b<p>c</p></li></ul><p>x</p>")
    b = page_text.parse("<p>n</p><ul><li>b<p>d</p></li></ul><p>x</p><p>y</p>")
    pairs = page_text.align(a, b)
    assert ("c", "d") in {(x.text, y.text) for x, y in pairs if x.tag == "#text"}
    assert len(pairs) == page_text._matched(a, b, {})


def test_pieces_equal_the_library(spark, odd, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in pieces.encoded(docs.unionByName(odd.select("doc_id", "text")), PIECES, ["doc_id", "text"]).collect():
        source, decoded = r[1] or "", r[4]
        assert r["ids"] == own.encode(source) and r["n_ids"] == len(r["ids"])
        assert decoded == source.replace("▁", " ")
    assert pieces.encoded(none, PIECES, ["doc_id"]).count() == 0


def test_pieces_hold_the_words_of_small_blocks(spark, monkeypatch):
    def small(batch, column, size):
        assert size <= 2 << 20
        return textbytes.slices(batch, column, size)

    monkeypatch.setattr(pieces, "slices", small)
    docs = spark.createDataFrame([(i, "some words") for i in range(9)], "doc_id long, text string")
    assert pieces.encoded(docs, PIECES, ["doc_id"]).where("text = 'some words'").count() == 9


def test_frequent_words_outlive_the_rare_ones(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 20)
    coder, walked = pieces.Coder(pieces.read_model(PIECES)), []
    monkeypatch.setattr(coder, "_walk", lambda words: walked.extend(words) or pieces.Coder._walk(coder, words))
    texts = [" ".join(["common words here", *(f"r{k}x{i}" for i in range(12))]) for k in range(30)]
    got = [coder.encode([t])[0].tolist() for t in texts]
    assert walked.count("▁words") == 1 and len(coder.known) + len(coder.older) < 80
    assert got == [x.tolist() for x in pieces.Coder(coder.model).encode(texts)]
    assert [coder.decode(x) for x in got] == texts


def test_unigram_is_the_best_path():
    table = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -3.1, "ba": -1.0, "▁ab": -6.0}
    coder = pieces.Coder(pieces.Model("unigram", ["<unk>", *table], [0.0, *table.values()], [2, *[1] * len(table)], True))

    def best(text):
        if not text:
            return 0.0, []
        return max((table[text[:k]] + best(text[k:])[0], [text[:k], *best(text[k:])[1]]) for k in range(1, len(text) + 1) if text[:k] in table)

    for text in ("ab", "aba", "ba ab a", "abba ab", "bbbb"):
        assert [coder.model.pieces[i] for i in coder.encode([text])[0]] == [p for w in coder.split.findall("▁" + text.replace(" ", "▁")) for p in best(w)[1]]


def test_packing_round_trip(spark, odd, none):
    import public_tokenizers as public
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.packed(docs, path, public.PATTERN, 256)
    parts = {}
    for r in packing.unpacked(rows).collect():
        assert parts.setdefault((r["doc_id"], r["part"]), r["ids"]) is r["ids"]
    tok = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=packing.read_ranks(path), special_tokens={})
    for doc, text in docs.collect():
        ids = [x for k in range(10**6) if (doc, k) in parts for x in parts[doc, k]] if (doc, 1) in parts else parts[doc, 0]
        assert ids[-1] == packing.END and tok.decode(ids[:-1]) == text
    for r in rows.collect():
        spots, ids = np.frombuffer(r["positions"], np.uint16), np.frombuffer(r["ids"], np.uint16)
        assert len(ids) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == packing.END).all()
        assert all(spots[a:b].tolist() == list(range(b - a)) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))
    assert sum(len(r["doc_ids"]) for r in packing.packed(odd, path, public.PATTERN).collect()) >= odd.count()
    assert packing.packed(none, path, public.PATTERN).count() == 0


def test_best_fit_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths, room, rows = rng.integers(1, 65, 60), [], []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [r for r in range(len(room)) if room[r] >= lengths[k]]
            r = min(fits, key=lambda r: room[r]) if fits else len(room)
            if not fits:
                room.append(64)
                rows.append([])
            room[r] -= lengths[k]
            rows[r].append(k)
        got = packing.best_fit(lengths, 64)
        assert len(got) == len(rows) and sorted(k for r in got for k in r) == list(range(60))
        assert all(lengths[r].sum() <= 64 for r in got)


def test_rules(spark, odd, none, labels):
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 3), (2, "l one\nl one\n\nl one"), (3, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert (got[1]["n_repeat_words"], got[1]["base_failed"]) == (24, True)
    assert (got[2]["n_dup_lines"], got[2]["word_chars"]) == (2, 12) and got[3]["kept"] and got[3]["cutoff"] is None
    assert quality_rules.quality_rules(odd, labels).count() == odd.count()
    assert quality_rules.passing(odd, labels).columns == odd.columns
    assert quality_rules.quality_rules(none, labels).count() == quality_rules.passing(none, labels).count() == 0
    assert quality_rules.quality_rules(odd, labels.limit(0)).filter("kept AND base_failed").count() == 0


def test_cutoffs_keep_the_risk(spark):
    """The cutoff is the strictest whose exact binomial bound holds, then the most lenient as good."""
    from math import comb

    n, risk, alpha = 2000, 0.01, 0.05
    scores = [(i, 1, i % 40 if i < n else 100 + i % 50) for i in range(n + 400)]
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + 400)], "doc_id long, quality int")
    got = quality_rules.cutoffs(spark.createDataFrame(scores, "doc_id long, stratum int, badness int"), labels, risk, alpha).collect()
    assert [(r["stratum"], r["cutoff"]) for r in got] == [(1, 99)] or got[0]["cutoff"] in range(39, 102)
    lost = sum(b > got[0]["cutoff"] for i, _, b in scores if i < n)
    assert sum(comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(lost + 1)) <= alpha / 4


def test_personal_data(spark, odd, none):
    text = "é mail a.b@c.de x@y, ip 10.0.0.256 and 10.0.0.1; card 4111 1111 1111 1111, 4111111111111112; tel +49 (30) 1234-567; iban GB82WEST12345698765432 ssn 123-45-6789"
    docs = spark.createDataFrame([(1, text), (2, "a@" + ".a" * 30_000), (3, "1" * 50_000), (4, "id 123-45-6789")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs).collect()}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-567"),
        ("iban", "GB82WEST12345698765432"), ("national_id", "123-45-6789"),
    ]
    assert got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == ""
    assert personal_data.personal_data(odd).count() == odd.count() and personal_data.personal_data(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs).collect()}
    assert "[EMAIL] x@y" in clean[1] and "[CARD], 4111" in clean[1] and "a.b@c.de" not in clean[1] and clean[4] == "id 123-45-6789"
    assert personal_data.redacted(odd).exceptAll(odd).count() == 0


def test_account_numbers_end_at_their_length(spark):
    texts = ["GB82WEST12345698765432", "is GB82 WEST 1234 5698 7654 32.", "GB82WEST12345698765432ABC99", "DE89 3704 0044 0532 0130 00 BANK", "GB83 WEST 1234 5698 7654 32"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs).collect()}
    assert [clean[i] for i in range(5)] == ["[IBAN]", "is [IBAN].", "[IBAN]ABC99", "[IBAN] BANK", texts[4]]


def test_very_many_matches_in_one_text(spark):
    marks = ["a@b.co", "10.0.0.1", "+4930 1234567", "phone", "é\U0001f600 " * 700, "123-45-6789", "ssn 123-45-6789"]
    rng = np.random.default_rng(6)
    text = "; ".join(marks[k] for k in rng.integers(len(marks), size=3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = personal_data.personal_data(docs).collect()[0]
    want = []
    for kind in personal_data.KINDS:
        for m in re.finditer(kind.plain, text):
            near = re.search(rf"\b({kind.context})", text[max(0, m.start() - personal_data.NEAR) : m.start()].lower())
            if kind.name in ("email", "ip", "phone") or (kind.name == "national_id" and near):
                want.append((kind.name, m.start(), m.end()))
    assert got["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    plain, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in want):
        plain += [text[at:a], f"[{kind.upper()}]"]
        at = b
    assert personal_data.redacted(docs).collect()[0]["text"] == "".join(plain) + text[at:]


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    rows = [(None, f"w{i} " + "w " * 9, "a") for i in range(2000)] + [(i, "w " * 10, "b") for i in range(3000)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(by.taken - by.target) <= 20).all()
    assert got[got.doc_id.isna()].copies.nunique() > 1 or (by.target == 2 * by.source_size).any()


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got["size"] * got.copies).all()
    by = got.groupby(["target", "source_size"]).taken.sum().reset_index()
    assert (abs(by.taken - by.target) <= 60).all() and (by.target <= 2 * by.source_size).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1
    again = mixing.mixture(docs.repartition(5)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    assert mixing.mixed(docs).count() == got[got["size"] > 0].copies.sum() + got[got["size"] == 0].copies.sum()
    assert mixing.mixture(odd).count() == odd.count() and mixing.mixed(odd).columns == odd.columns
    assert mixing.mixture(none).count() == mixing.mixed(none).count() == 0
