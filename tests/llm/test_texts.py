"""Operators on single texts against brute force, round trips and held-out labels."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import bpe, chat, decontamination, html_text, language_id, suffix_dedup, toxicity, url_filter

from .helpers import covered, cut, documents, fold, sha


# --- suffix-array dedup


def _repeats(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdé ", k=k))
    passages = [word(k) for k in (380, 399, 400, 401, 450, 700, 1500)]
    texts = []
    for _ in range(40):
        texts.append("".join(rng.choice([word(rng.randrange(300)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))))
    return texts


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE, 700])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = [*_repeats(7), None, "", "short", "a" * 399, "b" * 400, "c" * 401, "de" * 900, "x" * 3000, "fé" * 500]
    texts += [texts[0], texts[0], texts[3]]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(documents(spark, rows)).collect()}
    data = [(t or "").encode() for t in texts]
    for k, (b, mask) in enumerate(zip(data, covered(data), strict=True)):
        spans = len(re.findall(b"\1+", mask))
        kept = cut(b, mask)
        assert got[k] == (len(b), sum(mask), spans, sha(kept), len(kept), kept.decode(errors="ignore")), k


@pytest.mark.parametrize("length", [128, 200, 256, 320, 600])
def test_suffix_dedup_of_other_lengths_equals_brute_force(spark, length):
    texts = [*_repeats(length), "a" * (length - 1), "b" * length, "de" * length]
    kept = suffix_dedup.remove_repeats(documents(spark, [(k, t, None) for k, t in enumerate(texts)]), length)
    data = [t.encode() for t in texts]
    want = {k: cut(b, mask).decode(errors="ignore") for k, (b, mask) in enumerate(zip(data, covered(data, length), strict=True))}
    assert {r.doc_id: r.text for r in kept.collect()} == want


def test_last_step_needs_both_names(spark, monkeypatch):
    """Unlike strings whose first names are all equal stay: the second names tell them apart."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=500)) for _ in range(6)]
    plain = suffix_dedup._pair

    def blunt(a, b, seeds=suffix_dedup.SEEDS[0]):
        return np.zeros_like(a) if seeds == suffix_dedup.SEEDS[0] else plain(a, b, seeds)

    monkeypatch.setattr(suffix_dedup, "_pair", blunt)
    parts = [p for t in texts for p in suffix_dedup._block_rows(t.encode(), b"k" * 16, 1, 400, None)]
    assert len(set(np.concatenate([p[4] for p in parts]).tolist())) == 1
    assert len(set(np.concatenate([p[5] for p in parts]).tolist())) == 6 * 101


def test_suffix_dedup_text_and_empty_table(spark):
    rng = random.Random(1)
    shared = "".join(rng.choices("abc", k=420))
    rows = [(1, f"one {shared} uno", "en"), (2, f"two {shared}", None), (None, None, "x")]
    kept = suffix_dedup.remove_repeats(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    data = [t.encode() for _, t, _ in rows[:2]]
    one, two = (cut(d, m).decode() for d, m in zip(data, covered(data), strict=True))
    assert {(r.doc_id, r.text, r.lang) for r in kept.collect()} == {(1, one, "en"), (2, two, None), (None, None, "x")}
    assert suffix_dedup.digests(documents(spark, [])).count() == 0


# --- decontamination


def _hit_words(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = norm(text), set(), set()
    for item, t in items:
        w = norm(t)
        n = min(len(w), 10)
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)


@pytest.mark.parametrize("bound", [decontamination.MAX_WINDOWS, 3])
def test_decontamination_equals_brute_force(spark, bound):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, sentence(n)) for k, n in enumerate((25, 10, 11, 9, 3, 1, 30, 2))] + [(None, sentence(12)), (50, None), (51, ""), (52, "?!"), (3, sentence(14))]
    items += [(10, items[0][1]), (9, items[1][1])]
    texts = [f"{sentence(8)}, {rng.choice(items)[1] or ''}! {sentence(5)}" for _ in range(30)]
    texts += [items[0][1].upper(), " ".join((items[6][1] or "").split()[4:22]), None, "", "w1", "Ünïcode w2-w3", f"{items[1][1]} " * 300]
    docs = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, hash long")
    found = decontamination.digest(decontamination.contamination(docs, bench, max_windows=bound))
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert got == {k: _hit_words(t, items) for k, t in enumerate(texts)}


def test_decontamination_outputs(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents(spark, [(1, "Say: Alpha, beta gamma; end.", "en"), (2, "alpha beta", None), (None, None, None), (2, "alpha beta", None)])
    text = decontamination.without_spans(decontamination.contamination(docs, bench)).select("doc_id", "text").collect()
    assert sorted(map(tuple, text), key=str) == sorted([(1, "Say: ,  ; end."), (2, "alpha beta"), (None, None), (2, "alpha beta")], key=str)
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2]
    none = bench.limit(0)
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


# --- chat


HARD = [
    "", "plain", "### Assistant: hi", "</turn>", "\\</turn>", "\\\\### x:\n</turn>\n", "a\\", "\\", "\n</turn>\n### user:\nno", "### ", "#### ", "</turn", "é😀\n\n",
    r"\### Assistant: </turn> ok",
]


@pytest.mark.parametrize("role", ["user", "assistant", "", "a:b", "a\nb", "### ", "\\n:", "</turn>"])
@pytest.mark.parametrize("text", HARD)
def test_chat_turn_round_trip(role, text):
    assert [t[:2] for t in chat.parse(chat.render(role, text) + chat.render("user", "x"))] == [(role, text), ("user", "x")]


def test_chat_off_grammar():
    for bad in ("x", "### user\n", "### user:\nabc", "### user:\nabc\n</turn>", "### user:\nabc</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, None, "user", "n")]
    rows += [(3, k, "assistant", t) for k, t in enumerate(HARD)]
    turns = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(turns)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        body = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv] == (len(own), sha(body.encode()), len(loss), sha(loss.encode()))
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, reference_encoder):
    rng = random.Random(8)
    texts = ["", None, "Hello world's", "a" * 3000, " " * 700 + "x", "é日本語😀" * 60, "ab" * 999, "\x00<|endoftext|>\r\n\t", "12345 67"]
    texts += ["".join(chr(rng.randrange(32, 0x600)) for _ in range(500)) for _ in range(5)] + ["Hello world's"]
    rows = bpe.encode_documents(documents(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()
    for r in rows:
        want = reference_encoder.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == sha(b"".join(i.to_bytes(4, "little") for i in want)) and r.decoded_sha256 == sha((texts[r.doc_id] or "").encode())
    encoded = spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode_documents(documents(spark, [])).count() == 0


# --- language


def test_forward_sums_all_segmentations():
    pieces = ("a", "ab", "b", "▁", "▁a", "▁ab")
    model = language_id.fit_counts({"x": {"ab": 3, "aab": 1}, "y": {"bb": 2}}, pieces)
    lattice = language_id.Lattice(pieces)
    table = dict(zip([*pieces, "?"], model.table, strict=False))

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            p = table.get(word[:n])
            if p is None and n == 1:
                p = table["?"]
            if p is not None:
                out += p[k] * total(word[n:], k)
        return out

    import numpy as np

    words = ["ab", "aabb", "b", "abcab", "ba"]
    got = lattice.word_logs(words, model.table)
    want = np.log([[total("▁" + w, k) for k in range(2)] for w in words])
    assert np.allclose(got, want) and np.allclose([lattice._long(w, model.table) for w in words], want)


def test_vocabulary_holds_long_pieces_and_letters_without_case():
    pieces = language_id.vocabulary()
    assert max(map(len, pieces)) > 9 and {"一", "ا"} & set(pieces) and all(p == p.lower() for p in pieces)
    texts = {"x": "一人大中", "y": "の人はに"}
    model = language_id.fit_counts({k: {w: 5 for w in t} for k, t in texts.items()}, pieces)
    assert language_id.Scorer(model).predict(["大中一", "はのに"])[0] == ["x", "y"]
    long = max(pieces, key=len).lstrip(language_id.MARK)
    lattice = language_id.Lattice((*sorted({*long, language_id.MARK + long, language_id.MARK}),))
    table = np.array([[0.01] * len(lattice.ids[:-1]) + [1e-7, 0.0]]).T
    assert np.allclose(lattice.word_logs([long], table), np.log(0.01 + 0.01 ** (len(long) + 1)))


def test_long_words_train_like_short_ones(monkeypatch):
    rng = random.Random(8)
    pieces = ("a", "b", "ab", "ba", "aab", "abab", language_id.MARK, language_id.MARK + "a")
    p = np.array([rng.random() for _ in pieces] + [1e-3, 0.0])
    p /= p.sum()
    lattice = language_id.Lattice(pieces)
    words = ["".join(rng.choice("abx") for _ in range(n)) for n in (1, 5, 32, 33, 40, 64)]
    counts = np.array([3.0, 1, 2, 5, 1, 7])
    mixed = lattice.expected(words, counts, p)
    monkeypatch.setattr(language_id, "LONG_WORD", 64)
    assert np.allclose(mixed, lattice.expected(words, counts, p))
    # every letter and the mark are used once, also across stretches and where a probability has no double
    word = "".join(rng.choice("abx") for _ in range(9000))
    uses = lattice.expected([word], np.array([2.0]), p)
    letters = uses[:-2] @ np.array([len(x) for x in pieces]) + uses[lattice.unknown]
    assert abs(letters - 2 * 9001) < 1e-4 and uses[lattice.none] == 0
    # a language whose text is one long run is learned
    model = language_id.fit_counts({"x": {"ab" * 40: 1}, "y": {"ba" * 3 + "b" * 60: 1}}, pieces)
    assert language_id.Scorer(model).predict(["abababab", "bbbbbb"])[0] == ["x", "y"]


def test_language_edge_cases(spark):
    rows = [(k, t * 5, g) for k, (t, g) in enumerate([("the cat and the dog ", "en"), ("le chat et la souris ", "fr")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 ... _", "fr"), (103, "the " * 20000, None), (104, "a" * 5000, None), (None, "the dog and", "en"), (103, "the " * 20000, None)]
    got = [tuple(r) for r in language_id.identify(documents(spark, rows)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(by[k][2:] == ("und", 0.0) for k in (100, 101, 102))
    assert all(r[1] == (r[0] is not None and fold(r[0], 5) == 0) for r in got)
    assert by[103][2] == "en" and by[104][2] in ("en", "fr") and all(by[k][2] == rows[k][2] for k in range(40))
    assert language_id.identify(documents(spark, [])).count() == 0
    unlabelled = language_id.identify(documents(spark, [(1, "words", None)])).first()
    assert unlabelled.lang_pred == "und"


# --- toxicity


def test_toxicity_learns_and_marks_spans(spark):
    rng = random.Random(6)
    clean = ["tree", "house", "river", "stone", "cloud", "green", "walks"]
    rows, labels = [], []
    for k in range(240):
        words = rng.choices(clean, k=30)
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(30)] = words[3] = "awfulword"
        rows.append((k, " ".join(words) + ".", None))
        labels.append((k, 1, int(bad)))
    rows += [(500, None, None), (501, "", None), (502, "river " * 20000, None), (None, "awfulword awfulword", None), (1, rows[1][1], None)]
    labels += [(None, 0, 1), (600, 0, 1), (3, None, None)]
    docs = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in toxicity.predict(docs, known).collect()]
    assert len(got) == len(rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in got)
    assert all(r[1] == (r[0] is not None and fold(r[0], 4) == 2) for r in got)
    assert all(r[3] == int(r[0] % 4 == 0) for r in got if r[0] is not None and r[0] < 240)
    assert all(r[3] == 0 for r in got if r[0] in (500, 501, 502)) and all(r[3] == 1 for r in got if r[0] is None)
    model = toxicity.fit(docs, known)
    spans = toxicity.score(documents(spark, [(1, "A tree, awfulword house", None)]), model, spans=True).first().spans
    assert [(s.start, s.end) for s in spans] == [(8, 17)]
    assert toxicity.predict(docs.limit(0), known).count() == 0
    assert {r.predicted for r in toxicity.predict(docs, known.limit(0)).collect()} <= {0, 1}


def test_toxicity_takes_one_text_of_a_hot_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_texts", lambda rows: seen.extend(rows))
    docs = documents(spark, [(1, f"text {k}", None) for k in range(50)] + [(2, None, None), (3, "", None)])
    toxicity.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id bigint, toxic int"))
    assert sorted((t is None, y) for t, y in seen) == [(False, 1), (False, 1), (True, 0)]


def test_toxicity_spans_are_places_in_the_text(spark):
    rng = random.Random(6)
    texts = [rng.choices(["tree", "house", "river", "stone", "cloud", "green", "walks"], k=30) for _ in range(240)]
    for k in range(0, 240, 4):
        texts[k][3] = texts[k][20] = "awfulword"
    model = toxicity.fit(documents(spark, [(k, " ".join(w) + ".", None) for k, w in enumerate(texts)]), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id bigint, toxic int"))
    text = "\u0130\u0130 I\u0130 awfulword \u0130 tree, AWFULWORD"
    got = toxicity.score(documents(spark, [(1, text, None), (2, None, None)]), model, spans=True).orderBy("doc_id").collect()
    assert {text[s.start:s.end].lower() for s in got[0].spans} == {"awfulword"} and len(got[0].spans) == 2
    assert got[1].spans == []


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    lengths, emit, t = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = toxicity.Sentences(lengths).marginals(emit, t)
    want, moves, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weight, on, turn = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emit[at + i] for i in range(n) if tags[i]) + sum(t[a, b] for a, b in itertools.pairwise(tags)))
            weight += w
            on += w * np.array(tags)
            for a, b in itertools.pairwise(tags):
                turn[a, b] += w
        want += (on / weight).tolist()
        moves += turn / weight
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, moves)


# --- html


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>one<li>two</ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p>First  <b>bold
</b>text&nbsp;&#8212; x<br>y<p>Second<aside>see also</aside><form><p>name</p></form><div class="share-bar share">tweet</div>
<p>Third</article><div id="comments"><article><p>reader</p></article></div><footer>foot</footer></body></html>"""


def test_html_structure():
    text = html_text.text_of(html_text.blocks_of(PAGE), None)
    assert text == "Head & line\n\nFirst bold text — x y\n\nSecond\n\nThird"
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("") == [] and html_text.blocks_of("<") == [("<", "open")]


def test_html_of_any_bytes_gives_blocks():
    assert html_text.blocks_of("<article>a<![foo[b]]>c</article>")
    assert html_text.blocks_of("<article>a <![ x]> c</article>")
    rng = random.Random(12)
    bits = ["<![", "<!", "<!--", "-->", "]]>", ">", "<", "CDATA[", "foo[", "if IE]", "<article>", "</article>", "<p", "</p>", " x ", "&#", "&amp", "[", "]", "\x00", "<?", "<script>", "DOCTYPE", "'", '"', "="]
    for _ in range(20_000):
        html_text.blocks_of("".join(rng.choices(bits, k=rng.randrange(1, 14))))


def test_html_repeats_on_a_host(spark):
    frame = "<div>All rights reserved by the example company of this place</div>"
    rows = [(k, f"http://h.com/{k}", f"<html><body>{frame}<div>Unique words number {k} {'abc' * k} stand here for once</div></body></html>") for k in range(4)]
    rows += [(10, "http://other.com/", f"<body>{frame}</body>"), (11, None, None), (12, "http://h.com/x", ""), (2, rows[2][1], rows[2][2]), (13, "x", PAGE), (14, "http://h.com/y", "<p>" + "w " * 50000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    by = {r[0]: r[2] for r in got}
    assert all(by[k] == f"Unique words number {k} {'abc' * k} stand here for once".replace("  ", " ") for k in range(4))
    assert by[10] == "All rights reserved by the example company of this place" and by[11] == by[12] == "" and by[13].startswith("Head & line")
    assert len(by[14]) == 99999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_copies_on_a_host_keep_their_text(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    frame, article, long_frame = words(9), words(160), words(60)
    other = article.split()
    other[70] = "changed"
    texts = [article, " ".join(other), article + " more", *(words(50) for _ in range(5))]
    html = [f"<body><div>{frame}</div><p>{t}</p><div>{long_frame}</div></body>" for t in texts]
    rows = [(k, f"http://copies.com/{k}", h) for k, h in enumerate(html)]
    rows += [(20 + k, f"http://two.com/{k}", f"<body><p>{t}</p></body>") for k, t in enumerate(texts[:2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == dict(enumerate(texts)) | {20: texts[0], 21: texts[1]}


# --- urls


def test_html_notices_inside_articles_are_found_by_repeats(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    notice, short, passage, copied = words(9), words(5), words(40), [words(8) for _ in range(6)]
    page = lambda *blocks: "<body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body>"
    texts = [(words(30), notice, words(20)) for _ in range(6)]
    rows = [(k, f"http://notes.com/{k}", page(*t)) for k, t in enumerate(texts)]
    rows += [(10, "http://notes.com/a", page(notice)), (11, "http://notes.com/b", page(words(9), notice[:-1]))]
    # copies with other ends, and a passage on most pages of a host: kept whole
    rows += [(20 + k, f"http://copies.com/{k}", page(words(30), *copied, passage)) for k in range(8)]
    # fewer than half of the host's pages, and too few pages
    rows += [(40 + k, f"http://some.com/{k}", page(words(30), short if k < 6 else words(5))) for k in range(13)]
    rows += [(60 + k, f"http://few.com/{k}", page(words(30), notice)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    plain = {k: "\n\n".join(t for t, _ in html_text.blocks_of(h)) for k, _, h in rows}
    assert all(got[k] == "\n\n".join(t[::2]) for k, t in enumerate(texts))
    assert all(got[k] == plain[k] for k in plain if k >= 10)


def _articles_by_hand(pages):
    """The rule for articles on whole streams: (host, texts of the blocks) by page, in plain Python."""
    runs_of = lambda blocks: {tuple(t[i : i + 6]) for t in [" ".join(blocks).split()] for i in range(len(t) - 5)}
    out = {}
    for host in {h for h, _ in pages.values()}:
        distinct = {blocks for h, blocks in pages.values() if h == host}
        long = Counter(b for blocks in distinct for b in set(blocks) if len(b.split()) >= 24)
        voters = [blocks for blocks in distinct if not any(long[b] > 1 for b in blocks)]
        often = lambda seen: {x for x, n in Counter(seen).items() if n >= 5 and 2 * n > len(voters)}  # noqa: B023, E731
        whole, runs = often(b for blocks in voters for b in set(blocks)), often(r for blocks in voters for r in runs_of(blocks))
        for k, (h, blocks) in pages.items():
            if h != host:
                continue
            tokens, covered, at, drop = " ".join(blocks).split(), set(), 0, []
            for i in range(len(tokens)):
                covered |= set(range(i, i + 6)) if tuple(tokens[i : i + 6]) in runs else set()
            for b in blocks:
                size = len(b.split())
                drop.append(b in whole or covered >= set(range(at, at + size)))
                at += size
            gone = sum(len(b.split()) for b, d in zip(blocks, drop, strict=True) if d)
            out[k] = "\n\n".join(b for b, d in zip(blocks, drop, strict=True) if not d or 2 * gone > len(tokens))
    return out


def test_html_every_place_of_an_article_is_in_the_order(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    first, second, third, rare, copied = words(9), words(8), words(12), words(10), words(30)
    pages = {k: ("two.com", (words(20), first, second, words(14))) for k in range(6)}
    pages[6] = ("two.com", (words(40), f"{first} {second}", words(5)))  # both in one block, and in one that goes on
    pages[7] = ("two.com", (words(40), f"{first} {words(3)}", second))
    pages[8] = pages[6]
    pages |= {k: ("few.com", (words(20), f"{first} {second}")) for k in range(10, 14)}
    for k in range(100, 260):  # more pages than are counted together
        blocks = [words(25), third if k % 2 else f"{words(2)} {third}", *([rare] if k % 20 < 9 else []), *([copied] if k > 240 else [])]
        pages[k] = ("large.com", tuple(rng.sample(blocks, len(blocks))))
    pages |= {300 + k: ("large.com", (words(30), f"{third} {third}")) for k in range(3)}
    page = lambda blocks: "<body><nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body>"
    rows = [(k, f"http://{host}/{k % 8}", page(blocks)) for k, (host, blocks) in pages.items()]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == _articles_by_hand(pages)
    assert got[6] == got[8] == "\n\n".join(pages[6][1][::2]) and first in got[7] and second not in got[7]
    assert third not in got[301] and third in got[100] and third not in got[101]


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://a.net/x", None), (2, "http://WWW.Example.NET/en/1#f", ""), (3, "http://b.com/p", link("http://a.net/x")), (4, "http://c.com/p", link("/q")),
        (5, "http://c.com/q", link("http://b.com/p")), (6, "http://d.com/", link("http://x.org/fr/1") + link("http://a.net/y")), (7, None, link("http://a.net/x")),
        (8, "no scheme", None), (9, "http://net", None), (10, "http://sub.example.com/de/?q", None), (11, "http://example.net/de/", None), (12, "http://notnet/", None),
        (13, "http://e.com/a", '<meta http-equiv="refresh" content="0; url=http://a.net/z">'), (1, "http://a.net/x", None),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    redirects = spark.createDataFrame([("http://f.com/", "http://e.com/a"), (None, "http://f.com/"), ("http://g.com/", "http://g.com/")], "source string, target string")
    extra = spark.createDataFrame([(20, "http://f.com/", None, "h")], pages.schema)
    got = [tuple(r) for r in url_filter.judge(pages.union(extra), redirects).collect()]
    by = {r[0]: (r[2], r[3], r[4], r[5]) for r in got}
    assert len(got) == len(rows) + 1
    assert by[1] == ("a.net", "/x", "net/", "block") and by[2] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert [by[k][3] for k in (3, 4, 5, 13, 20)] == ["block"] * 5 and all(by[k][2] is None for k in (3, 4, 5, 13, 20))
    assert by[6][3] == "allow" and by[7] == ("", "", None, "allow") and by[8] == ("", "", None, "allow")
    assert by[9] == ("net", "", None, "allow") and by[10][2:] == ("example.com/de/", "block") and by[11][2] == "net/" and by[12][3] == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == sha(b"")
