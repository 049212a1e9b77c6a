"""Chat format, token counts, decontamination and page text against plain versions."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from brute import words
from hypothesis import given, settings, strategies as st

from jobpanel.llm import chat, decontam, html_text, token_counts

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string"


# --- chat format ---------------------------------------------------------------

def turns_digest(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


ODD = ["", None, "plain", r"\### Assistant: </turn> ok", "</turn>", "### ", "a\\", "\\\\### x", "</turn", "é</turn>\n日本",
       ": ", "<", "#", "### user: hi</turn>\n", "x" * 50_000]


def test_chat_reads_back(spark):
    random.seed(1)
    rows = [
        (c, k, random.choice(["user", "assistant", "system", "od: d", "r\\", None]), random.choice(ODD))
        for c in [*range(40), None] for k in range(random.randint(1, 7))]
    rows += [rows[0]] * 2  # repeated turns
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", formatted string")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert len(out) == 41
    for c, row in out.items():
        own = sorted((k, r or "", t or "") for i, k, r, t in rows if i == c)
        pairs = [(r, t) for _, r, t in own]
        trained = "".join(t for r, t in pairs if r == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(own), turns_digest(pairs))
        assert (row.loss_chars, row.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_chat_text_is_plain_where_nothing_needs_escaping(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "dear </turn>"), (1, 0, "user", "hello")], TURNS)
    row = chat.format_conversations(df).first()
    assert row.formatted == "### user: hello</turn>\n### assistant: dear \\</turn></turn>\n"
    begin, end = row.loss_spans
    assert row.formatted.encode()[begin:end] == b"dear \\</turn>"


def test_chat_long_conversation_comes_in_parts(spark, monkeypatch):
    rows = [(c, k, "assistant", f"{k} " * 400) for c in (1, 2, 3) for k in range(60 if c == 2 else 2)]
    df = spark.createDataFrame(rows, TURNS)
    whole = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    schema = pa.schema([
        ("conv", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
    monkeypatch.setattr(chat, "PART_BYTES", 5_000)
    table = pa.table({"conv": [r[0] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    made = pa.Table.from_batches(list(chat._formatter(schema, "assistant")(iter(table.to_batches(max_chunksize=7)))))
    parts = made.filter(pa.compute.equal(made["conv"], 2))
    assert len(parts) > 3 and parts["part"].to_pylist() == list(range(len(parts)))
    joined = [p for text in parts["formatted"].to_pylist() for p in chat.read_back(text)]
    assert turns_digest(joined) == whole[2].turns_sha256


def test_chat_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(), st.text()), min_size=1, max_size=5))
def test_chat_round_trip(pairs):
    import numpy as np

    formatted, _ = chat.assemble(
        pa.array([r for r, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string()),
        np.array([0]), np.ones(len(pairs), bool))
    assert list(chat.read_back(formatted[0].as_py())) == pairs


# --- token counts --------------------------------------------------------------

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path(MODEL))


def test_tokens_equal_the_library(library):
    random.seed(2)
    bits = [" ", "  ", " " * 70, "a", "the", "tion", "é", "▁", "\n", "\t", "日本", "😀", "<s>", "</s>", "<unk>", "<0x0A>",
            "0", "***", "\x00", "ﬁ"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 40))) for _ in range(3000)]
    texts += [" " * n for n in range(120)] + [" " * n + "the" for n in range(120)] + ["a" * n for n in range(120)]
    texts += ["the" * 3000, " " * 30_000 + "x", "abc" * 20_000]
    assert token_counts.count_tokens(texts, MODEL) == [len(x) for x in library.encode(texts, num_threads=1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=6))
def test_tokens_equal_the_library_on_any_text(texts):
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path(MODEL))
    assert token_counts.count_tokens(texts, MODEL) == [len(x) for x in known.encode(texts, num_threads=1)]


def test_tokens_over_a_table(spark, library):
    texts = [None, "", "one", "one", "long text " * 5000]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], DOCS + ", n_tokens int")
    out = {r.doc_id: r for r in token_counts.with_token_counts(df).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (out[k].n_bytes, out[k].n_tokens, out[k].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert token_counts.with_token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(8)]
    one_by_one = [token_counts.count_tokens([t], MODEL)[0] for t in texts]
    assert one_by_one == token_counts.count_tokens(texts, MODEL)


# --- decontamination -----------------------------------------------------------

def plain_marks(text, items, size=13):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(size, len(v))
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                named.add("" if name is None else str(name))
    return len(w), len(hit), sorted(named)


def marked(spark, docs, items, **options):
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", n_hit int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return decontam.mark(df, bench, **options)


ITEMS = [
    (3, " ".join(f"b{i}" for i in range(20))), (10, "Short One"), (10, "short one"), (4, None), (5, ""), (6, "!!"),
    (None, "nameless item here"), (7, " ".join(f"B{i}" for i in range(5, 18))), (8, "é È ü")]
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [
    None, "", "...", "short, ONE", "clean words only", LONG + " " + " ".join(f"b{i}" for i in range(13)),
    " ".join(f"b{i}" for i in range(12)), "x " + " ".join(f"b{i}" for i in range(20)) + " y short one", "É È ü", "é È Ü",
    "nameless ITEM here", "short one short one"]


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_marks_equal_plain_search(spark, block):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    for r in marked(spark, docs, ITEMS, block_words=block).collect():
        n, hit, named = plain_marks(TEXTS[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.hit_items) == (n, hit, named)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


@pytest.mark.parametrize("words_limit,bytes_limit", [(20, 1 << 20), (1000, 64), (13, 1)])
def test_blocks_stay_within_their_limits(spark, words_limit, bytes_limit):
    """Whatever parts the words; long items in runs that hold every window once more."""
    items = [
        (1, "\n".join(f"u{i}" for i in range(100))), (2, "...".join(f"V{i}" for i in range(47))), (3, "a\tb"), (4, " "),
        (5, " " * 3000 + "far apart" + "\n" * 3000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    found, windows = [], set()
    for block in decontam.blocks(bench, "item_id", "text", words_limit, bytes_limit):
        n = sum(len(words(t)) for _, t in block)
        n_bytes = sum(len(t.encode()) + 1 for _, t in block)
        assert len(block) == 1 and n <= 13 or n <= words_limit and n_bytes <= bytes_limit
        for name, text in block:
            w = words(text)
            size = min(13, len(w))
            windows |= {(name, tuple(w[i:i + size])) for i in range(len(w) - size + 1)}
            found.append(name)
    wanted = set()
    for name, text in items:
        w = words(text)
        size = min(13, len(w))
        if size:
            wanted |= {(str(name), tuple(w[i:i + size])) for i in range(len(w) - size + 1)}
    assert windows == wanted and "4" not in found
    docs = [(0, items[0][1]), (1, "x " + " ".join(f"v{i}" for i in range(30, 47))), (2, "far apart"), (3, "clean")]
    for r in marked(spark, docs, items, block_words=words_limit, block_bytes=bytes_limit).collect():
        assert (r.n_words, r.n_hit, r.hit_items) == plain_marks(docs[r.doc_id][1], items)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    real = decontam.ragged.grams

    def colliding(hashes, offsets, n):
        grams, at, row = real(hashes, offsets, n)
        return grams % decontam.ragged.U64(3), at, row

    monkeypatch.setattr(decontam.ragged, "grams", colliding)
    rng = random.Random(4)
    items = [(str(k % 11), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for k in range(40)]
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    hits, sizes = decontam.Windows(items, 4).hits(pa.array(texts))
    covered, named = [set() for _ in texts], [set() for _ in texts]
    for row, begin, end, names in hits:
        covered[row] |= set(range(begin, end))
        named[row] |= set(names)
    for k, t in enumerate(texts):
        assert (int(sizes[k]), len(covered[k]), sorted(named[k])) == plain_marks(t, items, 4)


def test_marks_without_benchmark_or_documents(spark):
    assert [r.n_hit for r in marked(spark, [(1, "a b")], [(None, None)]).collect()] == [0]
    bench = spark.createDataFrame([], "item_id bigint, text string")
    out = decontam.mark(spark.createDataFrame([], DOCS), bench)
    assert out.count() == 0


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = {r.doc_id for r in decontam.remove_documents(docs, bench).collect()}
    assert kept == {k for k, t in enumerate(TEXTS) if not 0 < plain_marks(t, ITEMS)[1] * 20 >= max(1, len(words(t)))}
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[7] == "x  y " and cut[4] == TEXTS[4] and cut[0] is None and cut[5] == LONG + " "


# --- page text -----------------------------------------------------------------

def page(body, head="<title>T &amp; t</title><style>p{}</style><script>var t=\"</p>\";</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PARAGRAPHS = ["A first   paragraph of the article, with some text in it.", "Short.", "And a third one: it goes on; it ends."]
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and more</a></li></ul></nav>"
AROUND = (
    "<div class='ad'>Buy this now, it is a long advert with many words, really, believe us.</div>", "<footer>&copy; x</footer>",
    "<div id='comments'><p>Great article, thanks for writing it, I agree with all of it!</p></div>",
    "<aside><p>Related: another story, which is told elsewhere.</p></aside>",
    "<form><label>Your name</label><input name=q></form>", "<div class='cookie notice'><p>We use cookies, accept them.</p></div>")


def article(tag="article", sep="</p>"):
    inner = "<h1>The Title</h1>" + "".join(f"<p>{p}{sep}" for p in PARAGRAPHS)
    return f"<{tag}>{inner}</{tag.split()[0]}>"


WANTED = "\n".join(["The Title", *(" ".join(p.split()) for p in PARAGRAPHS)])


@pytest.mark.parametrize("tag", ["article", "main", "div class='post'", "div id=content"])
@pytest.mark.parametrize("sep", ["</p>", "", "<br>"])
def test_article_alone_is_extracted(tag, sep):
    body = NAV + AROUND[0] + article(tag, sep) + "".join(AROUND[1:])
    assert html_text.main_text(page(body)) == WANTED


def test_parts_inside_the_article_that_do_not_belong():
    inner = article().replace("</article>", AROUND[0] + AROUND[2] + AROUND[4] + "</article>")
    assert html_text.main_text(page(NAV + inner)) == WANTED


SIX = [f"Paragraph {k} of plain words, with a comma and an end. " * 8 for k in range(6)]
LONG_BODY = "".join(f"<p>{p}</p>" for p in SIX)
WHOLE = "\n".join(p.strip() for p in SIX)
COMMENTS = "<section class='comments'>" + "<p>I do agree with it, in all. </p>" * 60 + "</section>"


@pytest.mark.parametrize("body,wanted", [
    (f"<div class='layout with-sidebar'>{LONG_BODY}</div>", WHOLE),
    (f"<div class='post no-comments'>{LONG_BODY}</div>", WHOLE),
    (f"<form id='aspnetForm'>{LONG_BODY}</form>", WHOLE),
    (f"<div id='social-studies-course'>{LONG_BODY}</div>", WHOLE),
    (f"<div>{LONG_BODY}<ul>{'<li>One of some items, forty characters.</li>' * 6}</ul></div>", WHOLE + "\nOne of some items, forty characters." * 6),
    (f"<div><p>A short lead.</p></div><div>{LONG_BODY}</div>", "A short lead.\n" + WHOLE),
    (f"<article>{LONG_BODY}</article><article><p>A short one.</p></article>", WHOLE + "\nA short one."),
    (f"<div class='menu'><a href='x'>One</a></div><div>{LONG_BODY}</div>{COMMENTS}", WHOLE),
    (f"<article>{LONG_BODY}</article>{COMMENTS}{COMMENTS}{COMMENTS}", WHOLE),
    (f"<div class='with-ad wrap'><article>{LONG_BODY}</article><div class='ad'>Buy this.</div></div>", WHOLE),
    ("<nav>x</nav><div class='ad'>" + "An advert that is longer than all. " * 9 + "</div><article><p>Short, but it is all.</p></article>", "Short, but it is all."),
    (f"<div><ul>{'<li><a href=x>A link to elsewhere</a></li>' * 9}</ul></div><div>{LONG_BODY}</div>", WHOLE),
])
def test_marks_count_unless_they_hold_the_text(body, wanted):
    assert html_text.main_text(page(body)) == wanted
    assert html_text.main_text(page(f"<div class='footer-links'><a href='y'>Imprint</a></div>{body}")) == wanted


def test_markup_details():
    body = (
        "<article><p><b>Bold title<br><p>Text &eacute;&#233;&#xe9; &lt;b&gt; &amp;amp;\n\t next&nbsp;word "
        "<a href='x>y'>link</a>.</p><!-- <p>no</p> --><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>"
        "<script>if (a<b) '</p>'</script><p>1 < 2</p></article>")
    assert html_text.main_text(page(body)) == (
        "Bold title\nText ééé <b> &amp; next word link.\none\ntwo\nc1\nc2\n1 < 2")


def test_odd_pages(spark):
    long_page = page("<article>" + "<p>A sentence, of words.</p>" * 20_000 + "</article>")
    pages = [None, "", "no tags at all", "<p>open", "<", "<<<>>>", page(""), page(NAV), long_page, "<div " + "a='" * 5000]
    df = spark.createDataFrame([(k, h, "old") for k, h in enumerate(pages)] + [(2, pages[2], "old")], "page_id bigint, html string, text string")
    out = html_text.extract(df).collect()
    assert len(out) == len(pages) + 1
    by = {r.page_id: r for r in out}
    assert by[0].text == by[1].text == by[6].text == "" and by[2].text == pages[2] and by[3].text == "open"
    assert by[8].text.count("\n") == 19_999 and by[8].n_chars == len(by[8].text)
    assert html_text.extract(df.limit(0)).count() == 0
