"""Media, encoding, near-duplicates, substrings, HTML text and the pipeline against plain versions."""

import hashlib
import random
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import htmltext, media, neardup, pieces, substrings

SCHEMA = "doc_id long, text string, node string, nid long, value string, n_words long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[k], t, "clash", 1, "v", 2) for k, t in enumerate(texts)], SCHEMA)


def test_png_round_trip_and_hash(spark):
    texts = [None, "", "a", "x" * 576, "x" * 577, "Ünï\x00 " * 5000, "a"]
    stored = media.store(frame(spark, texts))
    got = {r.doc_id: r for r in media.load(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[k].payload == want and got[k].n_bytes == len(raw) and len(got[k].phash) == 8
    assert got[2].media == got[6].media and got[2].phash == got[6].phash
    assert media.load(stored.limit(0)).count() == 0


def filtered(samples, kind):
    """A PNG of ``samples`` with one row filter throughout."""
    h, w = samples.shape
    out = bytearray()
    for y in range(h):
        out.append(kind)
        for x in range(w):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(samples[y, x]) - [0, a, b, (a + b) // 2, near][kind]) & 255)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"k\x00v") + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters(kind):
    samples = np.random.default_rng(kind).integers(0, 256, (9, 13), dtype=np.uint8)
    assert (media.read_png(filtered(samples, kind)) == samples).all()


def test_damage_is_noticed():
    good = media.write_png(np.arange(576, dtype=np.uint8).reshape(-1, 24), chunk=40)
    assert (media.read_png(good).ravel() == np.arange(576, dtype=np.uint8)).all()
    for k in range(len(good)):
        with pytest.raises(ValueError):
            media.read_png(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    for k in (0, 8, 20, len(good) - 12, len(good) - 1):
        with pytest.raises(ValueError):
            media.read_png(good[:k])


def test_hash_moves_little_with_small_changes():
    one = np.random.default_rng(1).integers(0, 256, (48, 24), dtype=np.uint8)
    two = one.copy()
    two[7, 3] ^= 8
    far = np.random.default_rng(2).integers(0, 256, (48, 24), dtype=np.uint8)
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert apart(one, two) <= 4 < apart(one, far)


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_ids_are_the_librarys(spark, model):
    table = pieces.table(model)
    r = random.Random(3)
    letters = "abcdefghij ééüß \n\t  ▁<0x0A>—中文字ñ🎉\x00\r.,the ing tion "
    texts = ["", " ", "a" * 500, " " * 57, "x" + " " * 31 + "y", "\n\n a", "▁", "的" * 90, *("".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(4000))]
    parts = "th ing er re on tion an ed the and in of ble".split()
    texts += ["".join(r.choice(parts) + r.choice(["", "", " ", "\n"]) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    for t in texts:
        assert table.encode(t) == table.library.encode(t, add_eos=True), repr(t)
    got = {x.doc_id: x for x in pieces.encode(frame(spark, [None, *texts[:60]]), model).collect()}
    assert got[0].ids == [table.end] and got[0].decoded == ""
    assert all(got[k + 1].decoded == table.library.decode(table.library.encode(t, add_eos=True)) for k, t in enumerate(texts[:60]))


def test_small_caches_change_nothing(model):
    small, whole = pieces.PrefixTable(model, cache=3), pieces.table(model)
    text = "the and tion ingre ther onble " * 20
    assert small.encode(text) == whole.encode(text)


def brute_groups(texts, ids, size, percent):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [set(zip(*(w[j:] for j in range(size)), strict=False)) or ({tuple(w)} if w else set()) for w in words]
    up = list(range(len(texts)))
    find = lambda k: k if up[k] == k else find(up[k])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def mutated(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"m{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_brute_force(spark, size, percent):
    r = random.Random(size)
    word = lambda: f"w{r.randrange(4000)}"
    hot = [word() for _ in range(150)]  # a large family around one text, part of it linked, part not
    texts = [mutated(r, hot, r.randrange(0, 9)) for _ in range(150)] + [" ".join(hot)] * 5
    for _ in range(25):
        base = [word() for _ in range(r.choice([2, 5, 12, 40, 64, 70, 200, 900]))]
        texts += [mutated(r, base, r.randrange(0, 1 + len(base) // 25)) for _ in range(4)]
    passage = " ".join(word() for _ in range(30))
    texts += [" ".join(word() for _ in range(8)) + " " + passage for _ in range(60)]
    texts += [None, "", " \n", "One", "one", "ONE two", "one  TWO\n", "Ä ä", "ä Ä", "x " * 400, "x " * 300]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = {x.doc_id: x for x in neardup.cluster(frame(spark, texts, ids), size, percent).collect()}
    want = brute_groups(texts, ids, size, percent)
    assert {k: (x.n_shingles, x.component_id) for k, x in got.items()} == want
    assert all(x.kept == (x.component_id == k) for k, x in got.items())


def test_near_duplicates_with_nulls_repeats_and_nothing(spark):
    df = frame(spark, ["a b c d", "a b c d", "e f g h", "e f g h", None], [None, 4, 7, 7, None])
    got = sorted((str(x.doc_id), str(x.component_id), x.kept) for x in neardup.cluster(df, 3, 85).collect())
    assert got == [("4", "4", True), ("7", "7", True), ("7", "7", True), ("None", "4", False), ("None", "None", True)]
    assert neardup.cluster(df.limit(0), 3, 85).count() == 0 and neardup.deduplicated(df).columns == df.columns


def brute_kept(texts, ids):
    seen, out = set(), {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("group", [4000, 3])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "REACH", 16)
    r = random.Random(group)
    word = lambda: f"w{r.randrange(300)}"
    passages = [[word() for _ in range(r.choice([19, 20, 21, 35, 80]))] for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            parts += r.choice(passages) + [word() for _ in range(r.randrange(6))]
        texts.append(" ".join(parts))
    texts += texts[:9] + ["a " * 70, "a " * 50, "b c " * 60, None, "", "\n \t", "Z " * 19, "Z " * 19, " ".join(passages[3]) + "\n" + " ".join(passages[3])]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substrings.deduplicate(frame(spark, texts, ids)).collect()}
    assert got == brute_kept(texts, ids)


def test_repeats_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(25))
    got = sorted((str(x.doc_id), x.n_removed) for x in substrings.deduplicate(frame(spark, [text, text, text, None], [None, 5, 5, None])).collect())
    assert got == [("5", 0), ("5", 0), ("None", 0), ("None", 25)]
    assert substrings.deduplicate(frame(spark, []), "doc_id").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is long enough to look like text, is it not, dear reader of pages?</div><div class="cookie-notice">We use cookies.</div><article><header><h1>Head &amp; tail</h1></header><p><b>First&nbsp;one.<br><p>Second
 <i>one</i> &lt;x&gt; &eacute;.</p><aside>More on this</aside><p hidden>Secret</p><div class="comments"><p>I say!</p></div><form><p>Mail</p></form></article><footer>&copy; us</footer>"""


def test_article_text():
    assert htmltext.text_of(PAGE) == "Head & tail\n\nFirst one.\n\nSecond one <x> é."
    assert htmltext.text_of(None) == htmltext.text_of("") == htmltext.text_of("<p></p>") == ""
    assert htmltext.text_of("plain text") == "plain text" and htmltext.text_of("<article>short</article>") == "short"


def test_text_without_an_article_is_the_densest_span():
    body = "".join(f"<p>{'long sentences of text ' * 8}{k}.</p>" for k in range(5))
    page = f"<body><div class=menu><a>Home</a></div><p>Tiny</p><div></div>{'<ul><li></li></ul>' * 3}<div>{body}</div><footer>end</footer></body>"
    assert htmltext.text_of(page).count("\n\n") >= 4 and "end" not in htmltext.text_of(page) and "Home" not in htmltext.text_of(page)


def test_text_on_both_sides_of_a_long_advert_is_whole():
    aside = "<ul class=related><li><a>One</a></li><li>Two</li><li>Three</li></ul>"
    long = [f"{k} " + "long sentences of text " * 15 for k in range(6)]
    told = ["A heading", "By someone", "On a day", *(x.strip() for x in long), "So it ends."]
    block = "".join(f"<p>{x}</p>" for x in told[1:6])
    page = f"<body><div><a>Home</a></div><div><a>News</a></div><div><a>Shop</a></div><div><h1>{told[0]}</h1>{block}{aside}<p>{told[6]}</p><p>{told[7]}</p><p>{told[8]}</p>{aside}<p>{told[9]}</p></div><footer>end</footer>"
    assert htmltext.text_of(page) == "\n\n".join(told)
    shared = page.replace(told[0] + "</h1>", told[0] + "</h1>" + aside)
    assert htmltext.text_of(shared) == "\n\n".join(told)


def test_an_article_is_evidence_and_not_the_rule():
    long = [f"{k} " + "long sentences of text " * 15 + "end" for k in range(4)]
    told = "".join(f"<p>{x}</p>" for x in long)
    cards = "".join(f"<article><h3>Card {k}</h3><p>A teaser of another page, with a few words of it.</p></article>" for k in range(3))
    aside = "<ul class=related>" + "<li>x</li>" * 3 + "</ul>"
    body = "\n\n".join(long)
    assert body in htmltext.text_of(f"<body><div><div>{told}</div></div><div>{cards}</div></body>")
    for name in ("comment", "related", "comment-12 even", "hidden"):
        assert htmltext.text_of(f"<div>{told}</div><article class='{name}'><p>{'I say so. ' * 400}</p></article>".replace("class='hidden'", "hidden")) == body
    assert htmltext.text_of(f"<article class='post no-comments tag-social'>{told}</article>") == body
    page = f"<div><a>Home</a></div><p>Off the article</p><article><header><h1>Head</h1></header>{aside}<div>{told}</div>{aside}<footer>f</footer><div><p>Short.</p></div></article><p>Legal words</p>"
    assert htmltext.text_of(page) == f"Head\n\n{body}\n\nShort."


def test_names_nominate_and_the_text_decides():
    long = [f"{k} " + "long sentences of text " * 15 + "end" for k in range(4)]
    told, body = "".join(f"<p>{x}</p>" for x in long), "\n\n".join(long)
    text = htmltext.text_of
    for frame in ('<div class="layout right-sidebar">', '<div id="page" class="sidebar-left">', '<div class="ad-free-content">', '<form id="aspnetForm">', '<div class="modal">'):
        assert text(f"<body>{frame}<div class=menu><a>Home</a></div><article>{told}</article><footer>f</footer>") == body, frame
        assert text(f"<body>{frame}<ul><li><a>Home</a></li></ul><h1>Top</h1>{told}") == "Top\n\n" + body, frame
    for head in ("post-header", "entry-header"):
        assert text(f"<article><div class='{head}'><h1>Title</h1></div>{told}</article>") == "Title\n\n" + body
    assert text(f"<article>{told}<p class='share-price'>Shares rose.</p><p class=modal-verbs>Must, may.</p><p class=share-links><a>Tweet</a></p></article>") == body + "\n\nShares rose.\n\nMust, may."
    inner = "<figure><img><figcaption>A picture.</figcaption></figure><p>Press the <button>Save</button> button.</p><p>So <math><mi>x</mi></math> grows.</p><p><button>Send</button></p>"
    assert text(f"<article>{told}{inner}</article>") == body + "\n\nA picture.\n\nPress the Save button.\n\nSo x grows."
    links = "".join(f"<li><a>Home {k}</a></li>" for k in range(5))
    assert text(f"<ul>{links}</ul><div>{long[0]}</div><ul>{links}</ul><div>Copyright</div>") == long[0]
    comments = "<div id=comments>" + "<article class=comment><p>I say so, and so do many others here.</p></article>" * 60 + "</div>"
    assert text(f"<body><h1>Top</h1>{told}{comments}") == "Top\n\n" + body


def test_odd_markup_loses_no_text():
    text = htmltext.text_of
    assert text("<article><p title=it's>Don't lose this.</p></article>") == "Don't lose this."
    assert text("<p>One</p>< 5 kg and more text") == text("<p>One<p>< 5 kg and more text") == "One\n\n< 5 kg and more text"
    assert text("<article><div class='content no-sidebar'><p>In</p><div class='site-cookie-box'>C</div></div></article>") == "In"
    assert text("<p>a <b and no end") == "a <b and no end" and text("<p>x</ >y<!-->z") == "xy" and text("<p>A<!doctype x>B<?pi ?>C") == "ABC"
    assert text("<svg>left open<p>Text</p>") == "left open\n\nText" and text("<p>Text</p><script>if (a<b) x()") == "Text"
    assert text("<p>On</p><div><span class=ad>x <span>y</span> z</span>w</div>") == "On\n\nw"
    assert text("<P CLASS=AD>x</P><SCRIPT>a</Script >b") == "b" and text("İ<script>x</SCRIPT><p>y") in ("İ", "İ\n\ny")


@pytest.mark.parametrize("part", ["<a '", '<a "', "<a x='", '<p x="', "<", "</", "<!--", "<script>", "<svg>", "<li>", "<div>", "<a b=c ", "</b>", "<p", "&amp", "<p><div></p>"])
def test_time_is_linear_in_the_page(part):
    def seconds(n):
        began = time.perf_counter()
        htmltext.text_of((part + "x ") * (n // (len(part) + 2)))
        return time.perf_counter() - began

    assert seconds(1_000_000) < 12
    page = "<p>" + "<li>" * 50_000 + "</b>" * 50_000 + "</p>" * 50_000
    began = time.perf_counter()
    htmltext.text_of(page)
    assert time.perf_counter() - began < 5


class Plain(HTMLParser):
    """Blocks of a page by the standard library's parser: those in <p> or <h1>, whether beside, whether in an article."""

    def __init__(self):
        super().__init__()
        self.blocks, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, dict(attrs).get("class") in ("menu", "related", "ad")))
        if tag in ("p", "h1", "li"):
            self.blocks.append(["", any(b for _, b in self.stack), any(t == "article" for t, _ in self.stack)])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("p", "h1", "li"):
            self.blocks[-1][0] += data


def plainly(page, window=3, surge=80, dive=24):
    """The distribution over those blocks: from the first surge, and what adjoins it, to the dive after the last.

    A block beside the text that has nine tenths of it is the text.
    """
    parser = Plain()
    parser.feed(page)
    blocks = [(" ".join(t.split()), beside, inside) for t, beside, inside in parser.blocks]
    whole = sum(len(t) for t, _, _ in blocks)
    blocks = [(t, beside and 10 * len(t) <= 9 * whole, inside) for t, beside, inside in blocks]
    sizes = [0 if beside else len(t) for t, beside, _ in blocks]

    def surging():
        return [k for k in range(len(sizes)) if sum(sizes[k : k + window]) > surge]

    strong = {j for k in surging() for j in range(k, min(k + window, len(sizes))) if sizes[j]} or range(len(sizes))
    inside = sum(sizes[k] for k in strong if blocks[k][2])
    if any(x[2] and not x[1] for x in blocks) and 2 * inside >= sum(sizes[k] for k in strong):
        sizes = [n if blocks[k][2] else 0 for k, n in enumerate(sizes)]
    found = surging()
    if not found:
        return [t for (t, _, _), n in zip(blocks, sizes, strict=True) if n]
    start, end = found[0], found[-1]
    behind = end + max(range(len(sizes[end : end + window])), key=sizes[end : end + window].__getitem__)
    while end < len(sizes) and (end <= behind or sum(sizes[end : end + window]) >= dive):
        end += 1
    while not sizes[start]:
        start += 1
    while start and sizes[start - 1]:
        start -= 1
    return [blocks[k][0] for k in range(start, min(end, len(sizes))) if sizes[k]]


def test_text_is_that_of_a_plain_distribution():
    """Flat pages, where every block has a parent of its own, so that only windows and articles decide."""
    r = random.Random(8)
    decided = 0
    for _ in range(400):
        parts = []
        for _ in range(r.randrange(1, 14)):
            size = r.choice([2, 4, 15, 60, 200])
            words = " ".join("word" for _ in range(size // 5 + 1)) + " &amp; it"
            kind = r.choice(["<section><p>{}</p></section>"] * 6 + ["<div class='menu'><ul><li>{}</li></ul></div>", "<div class='ad'><p>{}</p></div>", "<section></section>", "<article><section><p>{}</p></section></article>"])
            parts.append(kind.format(words))
        page = "<body>" + "".join(parts) + "</body>"
        want = plainly(page)
        assert htmltext.text_of(page) == "\n\n".join(want), page
        decided += len(want) < htmltext.text_of(page, surge=10**9).count("\n\n") + 1
    assert decided > 20


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, ""), (None, "v", "<p>" + "x " * 100_000, "")], "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert [g.n_chars for g in got] == [len(g.text) for g in got] and got[0] == got[1] and got[2].text == "" and got[3].n_chars == 199_999
    assert htmltext.extract(df.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark, model):
    import corpus_pipeline as p

    r = random.Random(5)
    text = lambda: " ".join(" ".join(f"Word{r.randrange(3000)}" for _ in range(12)) + "." for _ in range(8))
    clean = [text() for _ in range(30)]
    data = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate([*clean, clean[0], clean[1] + " one.", "short", None, "BUY!! NOW!! " * 50, clean[2] + " Or bob@mail.example.com too."])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    stages = dict(p.STAGES)
    docs = stages["quality rules"](spark, docs, "")
    assert sorted(x.doc_id for x in docs.collect()) == [*range(32), 35] and docs.columns == columns
    docs = stages["near duplicates"](spark, docs, "")
    assert sorted(x.doc_id for x in docs.collect()) == list(range(30)) and docs.columns == columns
    docs = stages["personal data"](spark, docs, "")
    assert docs.columns == columns
    mixed = stages["source mix"](spark, docs, "")
    assert mixed.columns == columns and 20 <= mixed.count() <= 45
    out = stages["encoding"](spark, mixed, "").collect()
    assert all(x.ids[-1] == 2 and x.decoded == clean[x.doc_id] for x in out)
    assert hashlib.sha256(" ".join(map(str, out[0].ids)).encode()).hexdigest()
    assert mixed.where(F.col("text").isNull()).count() == 0
