"""Operators 2 to 5, 9 and 10, and the pipeline."""

from __future__ import annotations

import itertools
import random
import sys
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import CLASHING, DOCS, got
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import decontaminate, html_extract, language_id, packing, token_files, tokens, warc
from matchloom.llm.common import Scratch


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path(), remembered=50)


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the library makes it, apart from the operators' own."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_path())
    return lambda text: fresh.encode(text, add_special_tokens=False).ids


_PARTS = st.one_of(st.text(st.sampled_from("ab 1'sé.\n\t  AZ,ñ😀中\x00\x1c\xa0 \r"), max_size=12), st.sampled_from(["<|endoftext|>", "<|endof", " word, word", "\n\n", " x"]))


@given(st.lists(st.lists(_PARTS, max_size=5).map("".join), max_size=6))
@settings(max_examples=400, deadline=None)
def test_encoder_equals_library(encoder, library, texts):
    assert [x.tolist() for x in encoder.encode_all(texts)] == [library(t) for t in texts]


def test_encoder_on_texts(encoder, library, pairs):
    texts = [t or "" for _, t in pairs]
    assert [x.tolist() for x in encoder.encode_rows(texts, 2000)] == [library(t) for t in texts]
    assert encoder.encode("a<|endoftext|>").tolist()[-1] == encoder.vocabulary - 1


def test_encoder_joins_new_words_in_arrays(library):
    """Words of known pieces take no call of Python each."""
    stems = ["".join(p) for p in itertools.product("abcdé", repeat=3)]
    code, texts = tokens.Encoder(tokens.default_path()), [" ".join(f"{a}.\n{b}12" for b in stems) for a in stems]
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = code.encode_all(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in found] == [library(t) for t in texts]
    assert calls["call"] < len(stems) ** 2 / 4, "fewer than a call for four of the different words"


def test_encoder_forgets_and_remembers(encoder, library):
    """Of more words than are remembered, long ones among them, in any order; signs, digits and spaces within words."""
    rng = random.Random(7)
    inner = ["", ".", ",\n", "\n\n", "\r\n", "\t", "'s", "'", "!'ll", "²", "½", "ª", "\xad", "0", "_", "—", "中", "\x1c", "\u180e", "\x7f"]
    words = ["".join(rng.choices("abÉß", k=rng.choice([1, 3, 70]))) + rng.choice(inner) + "".join(rng.choices("xY9'", k=2)) for _ in range(600)]
    for _ in range(40):
        texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=30)) for _ in range(3)] + ["", " "]
        assert [x.tolist() for x in encoder.encode_all(texts)] == [library(t) for t in texts]
    assert len(encoder.words.texts) <= 100 and len(encoder.many.texts) <= 100
    assert max(map(len, encoder.words.texts.to_pylist())) <= tokens.LONGEST


def test_token_files(docs, pairs, scratch, library):
    assert got(token_files.round_trip(docs, scratch)) == brute.token_files(pairs, library)
    assert got(token_files.round_trip(docs.limit(0), Scratch(docs.sparkSession, "t"))) == []


@given(st.integers(1, 20), st.integers(0, 300), st.randoms())
@settings(max_examples=80, deadline=None)
def test_bit_packing(bits, n, rng):
    ids = np.array([rng.randrange(1 << bits) for _ in range(n)], "<u4")
    data = token_files.pack(ids, bits)
    assert token_files.unpack(data, n, bits).tolist() == ids.tolist()
    assert len(data) == (n * bits + 7) // 8


def test_token_file_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << 15, n).astype("<u4") for n in (0, 5, 64, 63, 1, 500, 0)]
    out = token_files.Writer(f"{tmp_path}/a/x.tok", 15)
    for i, ids in enumerate(texts):
        out.add(i, ids)
    out.close()
    read = token_files.Reader(f"{tmp_path}/a/x.tok")
    assert [(d, x.tolist()) for d, x in read.documents()] == [(i, x.tolist()) for i, x in enumerate(texts)]
    whole = np.concatenate(texts)
    for a, b in ((0, 1), (60, 130), (300, 633), (7, 7)):
        assert read.ids(a, b).tolist() == whole[a:b].tolist()
    assert read.document(5).tolist() == texts[5].tolist()


@given(st.integers(1, 20_000), st.sampled_from([64, 100, 2048]))
@settings(max_examples=300, deadline=None)
def test_cuts(n, capacity):
    parts = packing.cuts(n, capacity)
    assert sum(x for x, _ in parts) == n
    assert all(x * k <= capacity for x, k in parts)
    assert all(x == capacity // k for x, k in parts[:-1])


def test_packing(docs, pairs, scratch, library):
    rows = packing.pack(docs, scratch, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for doc, text in pairs:
        ids = [*library(text or ""), 1]
        parts = sorted(by_doc.pop(doc), key=lambda r: r["start"])
        assert [i for r in parts for i in r["ids"]] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
        total += len(ids)
    assert not by_doc and sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert sum(r["length"] for r in parts) <= packing.CAPACITY
    assert len(by_sequence) * packing.CAPACITY <= total * 1.05 + 2 * packing.CAPACITY
    assert got(packing.pack(docs.limit(0), Scratch(docs.sparkSession, "t"))) == []


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, "Ten-word ITEMS: are found, whatever signs! stand (between) their words or line ends"),
    (3, "only three words"), (4, None), (5, "..."), (6, "one two three four five six seven eight nine ten eleven"), (30, "zwölf Boxkämpfer jagen"), (None, "alpha beta"),
]
TEXTS = [
    "x One two, three four five six seven eight nine ten ELEVEN y", "one two three four five six seven eight nine", "two three four five six seven eight nine ten eleven one two three",
    "ten word items are found whatever signs stand between their words or line ends", "a only three\nwords only three words b", None, "", "?!", "ZWöLF boxkämpfer JAGEN", "alpha beta", "only three wordsy",
]


@pytest.mark.parametrize("part", [16 << 20, 200])
def test_decontamination(spark, part):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, 2), (None, TEXTS[0], 1, 2)], "doc_id long, text string, row long, spans long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute.decontamination([*enumerate(TEXTS), (0, TEXTS[0])], [x for x in ITEMS if x[0] is not None])
    assert got(decontaminate.report(docs, items, part_bytes=part)) == expected
    assert sum(r[5] for r in expected) == 6
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs.where("doc_id is not null"), items, part_bytes=part).collect()}
    assert clean == {r[0] for r in expected if not r[5]}
    hit = next(r for r in decontaminate.scan(docs, items, part_bytes=part).collect() if r["doc_id"] == 0)
    assert decontaminate.text_spans(TEXTS[0].encode(), hit["spans"]) == [(2, len(TEXTS[0]) - 2)]


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert got(decontaminate.report(docs, items)) == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r[:4] for r in got(decontaminate.report(some, items))] == [(1, 2, 0, 0)]


@given(st.lists(st.text("ab é1.\x00\nÜ", max_size=20), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_grams(texts):
    grams = language_id.Grams(texts)
    counts, letters = grams.counts(), grams.letters()
    for i, text in enumerate(texts):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        expected = Counter(clean[j : j + 3] for j in range(len(clean) - 2) if clean[j + 1] != " ")
        own = {"".join(chr(p) if p else " " for p in letters[j]): int(counts[i, j]) for j in np.flatnonzero(counts[i])}
        assert own == dict(expected)


def language_rows():
    rng = random.Random(3)
    syllables = {"aa": ["tha", "ing", "er", "on"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["eau", "oi", "ment", "que"]}
    return [(i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang) for i, lang in enumerate(rng.choices(list(syllables), k=240))]


def test_language(spark):
    rows = language_rows()
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (1003, rows[0][1], None), (None, "x", "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, lang_pred string")
    found = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert len(found) == len(rows) + 4
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[d]["lang_pred"] == lang for d, _, lang in held) >= 0.97 * len(held) > 30
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in found.values())
    foreign = spark.createDataFrame([(2000, "ашдщ ывпро члдюб жэхъ " * 9, None, "x"), (2001, "ашдщ", None, "x")], docs.schema)
    known = {r["doc_id"] for r in language_id.keep_known(docs.unionByName(foreign), language_id.learn(docs)).collect()}
    assert 2000 not in known and 2001 in known  # too short to tell
    assert language_id.keep_known(docs, {}).count() == 0
    empty = docs.limit(0)
    assert language_id.learn(empty) == {} and got(language_id.identify(empty, {})) == []
    kept = language_id.keep_known(docs, language_id.learn(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows} and kept.count() == len(rows) + 2
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_language_of_a_very_long_text(monkeypatch):
    """Parts and slices give the vectors of the whole, and memory doesn't follow the text."""
    import tracemalloc

    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x6000)) + rng.choice(["", "", ". "]) for _ in range(30_000)), "", "a b", "x" * 3000]
    plain = language_id.Grams(texts)
    whole = plain.counts() @ language_id.gram_vectors(plain.letters(), 64)
    monkeypatch.setattr(language_id, "PART", 2000)
    monkeypatch.setattr(language_id, "AT_ONCE", 100)
    vectors, grams = language_id.bundles([*texts[:3], "x"], 64)
    assert np.allclose(vectors[:3], whole[:3]) and grams[:3].tolist() == plain.counts().sum(axis=1)[:3].tolist()
    monkeypatch.undo()
    tracemalloc.start()
    language_id.bundles(["".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=200_000)))], 1024)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_language_equals_a_plain_version(spark):
    """Prototypes and cosines from dictionaries of grams, one gram at a time."""
    rows = language_rows()[:80]
    own = {c: language_id._letter_vectors(np.array([c], np.uint32), 256)[0].astype(int) for c in {0, *(ord(x) for _, t, _ in rows for x in t if x.isalpha())}}

    def vector(text):
        clean = [0, *(0 if c == " " else ord(c) for c in text.lower()), 0]
        return sum((np.roll(own[a], 2) * np.roll(own[b], 1) * own[c] for a, b, c in zip(clean, clean[1:], clean[2:]) if b), np.zeros(256))

    sums: dict = defaultdict(lambda: np.zeros(256))
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            sums[lang] += vector(t)
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in language_id.identify(docs, language_id.learn(docs, 256), 256).collect():
        every = {lang: cosine(vector(rows[r["doc_id"]][1]), s) for lang, s in sums.items()}
        assert r["lang_pred"] == max(sorted(every), key=every.get) and abs(r["score"] - max(every.values())) < 1e-6


def test_warc(spark, scratch):
    pages = [(1, "http://a b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "x"), (6, "u", "é" * 100_000), (7, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, refers_to string")
    assert got(warc.round_trip(df, scratch)) == brute.warc(pages)
    files = warc.write(df, scratch.path("again"), least=1, frame_bytes=64)
    files = scratch.keep(files, "files-again")
    rows = {r["page_id"]: r for r in warc.read(files, with_payload=True).collect()}
    assert rows[3]["record_type"] == rows[4]["record_type"] == "response" and rows[1]["refers_to"] == 5
    assert rows[7]["payload"].decode() == pages[6][2] and rows[1]["url"] == "http://a%20b%0A"
    for r in files.collect():
        archive = warc.Reader(r["file"])
        for page in archive.index[:, 0].tolist():
            headers, _ = archive.record(page)
            assert headers["WARC-Record-ID"] == warc.record_id(page)
    assert got(warc.round_trip(df.limit(0), Scratch(spark, "t"))) == []
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "v", "y")], "page_id long, url string, html string").coalesce(1)
    files = scratch.keep(warc.write(twice, scratch.path("twice")), "files-twice").collect()
    names = [h["WARC-Record-ID"] for r in files for h, _ in warc.Reader(r["file"]).records()]
    assert len(names) == len(set(names)) == 3
    assert [r[:4:3] for r in got(warc.round_trip(twice, Scratch(spark, "t")))] == [(1, "response")] * 3


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a href=a>A</a></ul></nav><div id=wrap><div class="sidebar"><p>Related stories, long text here, with commas, and more text to score well.</div>
<div class="content"><h2>Title of story</h2><p>First  paragraph, with some length, that is long enough &amp; scored.<p>Second &lt;paragraph&gt; is here, and it is long as well, honestly.
<ul><li>one item<li>two item</ul><div class="ad-box">Buy now, cheap, best, offers today only for you!</div><form><input><label>Mail</label></form></div>
<div id="comments"><p>Reader one says: great article, thanks, love it, really do.</p></div></div><div class="cookie-notice">We use cookies</div><footer>(c)</footer></body></html>"""


def test_html(spark):
    assert html_extract.blocks(PAGE) == ["Title of story", "First paragraph, with some length, that is long enough & scored.", "Second <paragraph> is here, and it is long as well, honestly.", "one item", "two item"]
    cases = {
        "": [], "plain text & more": ["plain text & more"], "<p>x": ["x"], "<article><h1>Hi</h1></article>": ["Hi"], "<script>var a='</p>'": [], "a < b <a href=\"x": ["a < b"],
        "<div><p>a<b>c</b></p><br>d<!-- x": ["ac", "d"], "<article><header><h1>T</h1><p>by me</p></header><p>Some text.</p></article>": ["T", "Some text."], "<p hidden>x</p><p>y</p>": ["y"],
    }
    for source, expected in cases.items():
        assert html_extract.blocks(source) == expected
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert html_extract.blocks(deep) == ["deep text"]
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>z", "x")], "page_id long, url string, html string, text string")
    rows = got(html_extract.extract(df))
    assert [(r[0], r[2]) for r in rows] == [(1, " ".join(html_extract.blocks(PAGE))), (2, ""), (None, "z")]
    assert all(len(r[2]) == r[3] for r in rows) and rows[1][1] is None
    assert got(html_extract.extract(df.limit(0))) == []


def test_html_of_made_pages():
    """Pages built from parts: all of the article's blocks come out, in order, and nothing else."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ", " + word() + "."
    around = ['<nav><ul><li><a href="/">{}</a></li></ul></nav>', '<div class="sidebar"><p>{}</p></div>', '<footer><p>{}</p></footer>', '<div id="comments"><p>{}</p></div>', '<div class="ad-banner">{}</div>', '<aside><p>{}</p></aside>', "<script>var x = '{}';</script>", '<form><label>{}</label><input></form>', '<div class="cookie-consent">{}</div>', "<!-- {} -->"]
    for _ in range(150):
        parts = [sentence(rng.randint(12, 40)) for _ in range(rng.randint(3, 7))]
        body = "".join(f"<{t}>{p.replace(' ', rng.choice([' ', '  ', chr(10), ' <b></b>']), 1)}{rng.choice(['', f'</{t}>']) if t == 'p' else f'</{t}>'}" for t, p in ((rng.choice(["p", "p", "p", "blockquote"]), p) for p in parts))
        body = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', "<div><div>{}</div></div>"]).format(f"<h2>{parts[0][:20]}</h2>" + body)
        extra = [x.format(sentence(rng.randint(3, 9))) for x in rng.sample(around, rng.randint(0, len(around)))]
        at = rng.randint(0, len(extra))
        page = f"<html><head><title>{word()}</title></head><body>{''.join(extra[:at])}{body}{''.join(extra[at:])}</body></html>"
        assert html_extract.blocks(page) == [" ".join(parts[0][:20].split()), *parts]


@pytest.mark.parametrize("source", ["<a b='c' " * 110_000, "<a " * 300_000, "<a \"' " * 150_000, "<" * 1_000_000, "<a b=' " * 140_000 + ">", "<div>" * 100_000 + "</b>" * 100_000, "<!-" * 300_000])
def test_html_takes_time_by_length(source):
    """A megabyte of broken markup; retried to its end at every sign, it would take hours."""
    import time

    began = time.process_time()
    html_extract.blocks(source)
    assert time.process_time() - began < 60


@given(st.text("<>/p divbr\"'=!-&;aх", max_size=60))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(source):
    html_extract.blocks(source)


def test_pipeline(spark, tmp_path):
    """All five stages against plain versions on a fixture with every kind of case."""
    import corpus_pipeline

    rng = random.Random(9)
    base = language_rows()
    long_ = [" ".join(rng.choices([w for r in base for w in r[1].split()], k=150)) for _ in range(30)]
    passage = " ".join(long_[0].split()[40:110])
    texts = [r[1] for r in base[:60]] + long_ + [long_[3]] * 4 + [f"{passage} {t}" for t in long_[10:14]]
    texts += [f"{" ".join(rng.sample(long_[20].split(), 40))} one two three four five six seven eight nine ten eleven", None, "", "12", long_[5].replace(" ", "  ", 1)]
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", th long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = got(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))

    own = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    first = set(brute.components([(d, shingles(t)) for d, t in own.items()], lambda a, b: 5 * len(a & b) >= 4 * len(a | b)))
    own = {d: t for d, t in own.items() if d in first}
    lowest: dict[tuple, int] = {}
    for d, t in own.items():
        w = t.split()
        for i in range(len(w) - 49):
            lowest[tuple(w[i : i + 50])] = min(d, lowest.get(tuple(w[i : i + 50]), d))
    cut = {}
    for d, t in own.items():
        w = t.split()
        gone = {j for i in range(len(w) - 49) if lowest[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        if len(gone) < len(w):
            # A removed word takes the white space after it.
            import re

            cut[d] = "".join(x for j, x in enumerate(re.findall(r"^\s*|\S+\s*", t)[1:]) if j not in gone) if gone else t
    dirty = {r[0] for r in brute.decontamination(list(cut.items()), [x for x in ITEMS if x[0] is not None]) if r[5]}
    assert dirty
    expected = []
    code = tokens.Encoder(tokens.default_path())
    for d, t in cut.items():
        if d in dirty:
            continue
        ids, at = np.append(code.encode(t), 1).astype("<u4"), 0
        for length, _ in packing.cuts(len(ids)):
            expected.append((d, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
            at += length
    assert found == sorted(expected, key=lambda r: (r[0], str(r)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]
    assert CLASHING
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert got(corpus_pipeline.run(spark, f"{tmp_path}/none")) == []
