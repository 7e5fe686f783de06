"""Pure parts of the text operators against plain versions."""

import base64
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

from pagewright.llm import byte_bpe, decontam, html_blocks, lang_gru, line_rules, near_dup, pseudo_lm, quotes, toxic_crf
from pagewright.llm.common import shingles_of


def test_bpe_equals_the_library():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own, r = byte_bpe.ranks(path), random.Random(1)
    kinds = ["abcdefghij", "aab", "etaoinshr", "  \n\tab1", "éñüß aé", "aA1!.,'日本", "\x1c\x85\xa0 ​ x\r\n", ".-=_²½Ⅷ٣😀क्"]
    given = ["".join(r.choice(r.choice(kinds)) for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(600)]
    for text in [*given, "a" * 3000, "ab" * 2000 + "ba" * 99, " " * 2000, "=" * 1500, "é" * 777, " <|endoftext|> "]:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(np.frombuffer(packed, "<u4").tolist(), leaf=3) == text.encode()


def test_new_words_are_merged_side_by_side(monkeypatch):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own, r, calls = byte_bpe.Ranks(path, public_tokenizers.PATTERN), random.Random(4), []
    alone = byte_bpe.Ranks.merged
    monkeypatch.setattr(byte_bpe.Ranks, "merged", lambda self, data: calls.append(data) or alone(self, data))
    word = lambda: "".join(r.choice("etaoinéß日") for _ in range(r.randrange(1, 7)))
    text = " ".join(word() + r.choice(["", "", ".", "1"]) for _ in range(5000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(calls) < 500  # of long pieces only


def test_texts_in_slices_with_a_full_cache_and_all_white_space(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 3000)
    monkeypatch.setattr(byte_bpe, "_CACHE_BYTES", 500)
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own, r = byte_bpe.Ranks(path, public_tokenizers.PATTERN), random.Random(5)
    letters = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha())
    assert regex.fullmatch(r"\p{L}+", letters)  # so letters alone are one match
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or regex.match(r"\s", c)]
    given = [None, "", " ", "a ", " a", "x" * 9000, *(f"a{c} b{c}" for c in spaces), *(f"a {c}b" for c in spaces), *(f"{c}a b" for c in spaces)]
    given += [" ".join("".join(r.choice("abcdeé.'s\n1") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(60))) for _ in range(300)]
    batch = pa.record_batch([pa.array(range(len(given))), pa.array(given, pa.string())], names=["doc_id", "text"])
    slices = list(byte_bpe._slices(batch))
    assert len(slices) > 5 and sum(s.num_rows for s in slices) == len(given)
    found = []
    for ids, counts in (own.encode_many(s.column(1)) for s in slices):
        ends = np.cumsum(counts).tolist()
        found += [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    assert found == [library.encode_ordinary(text or "") for text in given]
    assert len(own.chunks) + len(own.older) < 1500


def test_chunks_that_come_back_count_in_the_cache(monkeypatch):
    """Otherwise it grows to all words of a corpus, as those it knows already come over from the older ones for nothing."""
    monkeypatch.setattr(byte_bpe, "_CACHE_BYTES", 9000)
    own, r = byte_bpe.Ranks(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN), random.Random(6)
    words = sorted({"".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(3000)})
    for _ in range(300):
        own.encode(" ".join(r.sample(words, 100)))
    assert len(own.chunks) + len(own.older) < 2500


def test_a_join_of_halves_is_the_encoding_of_the_whole():
    own, r = byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), random.Random(2)
    for _ in range(400):
        data = bytes(r.choice(b"aabetnih\xc3\xa9 ") for _ in range(r.randrange(2, 60)))
        cut = r.randrange(1, len(data))
        assert own.join(own.merged(data[:cut]), own.merged(data[cut:])) == own.merged(data)


def test_repeated_words():
    r = random.Random(3)
    for n in [0, 3, 5, 9, 30, 60] * 60:
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(n)]
        seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
        inside = {j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert line_rules.repeated_words(words) == len(inside)


def test_sketches_fill_and_estimate_similarity():
    r = np.random.default_rng(5)
    for n, share in ((1, 1.0), (3, 1.0), (40, 0.8), (900, 0.5), (5000, 0.9)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], r.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dup.sketch(a) == near_dup.sketch(b)).mean() - true) < 0.2
        assert (near_dup.sketch(a) == near_dup.sketch(a[::-1])).all()


def test_candidates_hold_every_planted_passage():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 7, 9, 14, 30, 59, 100, 300])]
    index = decontam.ItemIndex(items)
    texts, planted = [], set()
    for d in range(40):
        i, item = r.choice(items)
        kept = item.split()
        if d % 2 and len(kept) > 40:
            kept = kept[: int(len(kept) * 0.9)]
        if d % 3:
            texts.append(" ".join([*(word() for _ in range(r.choice([0, 40, 3000]))), *kept, *(word() for _ in range(60))]))
        else:
            texts.append(" ".join(word() for _ in range(200)))
        need = np.unique(shingles_of(item))
        for k, (_, other) in enumerate(items):
            need = np.unique(shingles_of(other))
            if np.isin(need, shingles_of(texts[-1])).sum() >= 0.8 * len(need):
                planted.add((d, k))
    assert len(planted) > 15 and planted <= index.candidates([shingles_of(t) for t in texts])


def test_main_text():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><div class="top-nav"><a href=1>Home</a></div><div><h1>Title</h1><p>' + "word " * 30 + "</p><script>var a='</p>'</script><p>x &amp; y&nbsp;z</p>"
        '<aside>side</aside><p class="ad">buy<p>' + "more " * 40 + '</p></div><form>name <input></form><section id="comments"><p>' + "blah " * 90 + "</p></section><footer>foot</footer></body>"
    )
    assert html_blocks.main_text(page) == "Title " + "word " * 30 + "x & y z " + ("more " * 40).strip()
    article = '<main><header>site</header><article class="post has-sidebar"><header><h1>T</h1></header><p>One<b>two</b>.<p>Three<br> four<div class="cookie-notice">c</div><article class="comment"><p>no</p></article></article></main>'
    assert html_blocks.main_text(article) == "T Onetwo. Three four"
    assert [html_blocks.main_text(x) for x in (None, "", "<p>Short.", "<article><p>cut &am", "<nav>x</nav>")] == ["", "", "Short.", "cut &am", ""]
    assert html_blocks.regions([0, 50, 40, 0, 0, 0, 90, 0], 80) == [(1, 3), (6, 7)]


def test_recurrent_gradients():
    model = lang_gru.Tagger(["a", "b"])
    r = np.random.default_rng(7)
    model.out = r.standard_normal(model.out.shape).astype(np.float32)
    x, y = r.integers(1, 255, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    mask, weight = np.ones((6, 4)), np.ones(4)

    def loss():
        p = model.tag(x)
        return -np.log(p[:, y, np.arange(4)]).sum() / mask.sum()

    for w, g in zip(model.weights(), model.gradients(x, mask, y, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = w[at]
        w[at] = keep + 1e-2
        up = loss()
        w[at] = keep - 1e-2
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * max(1e-2, abs(g[at]))


def test_chain_marginals():
    r = np.random.default_rng(8)
    lengths, links = np.array([3, 0, 5, 1]), r.standard_normal((2, 2))
    unary = r.standard_normal(lengths.sum())
    p, pairs = toxic_crf.marginals(unary, links, toxic_crf.Packed(lengths))
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        u, at = unary[at : at + n], at + n
        weight, hits, twos = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n if n else 0):
            tags = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(u[i] for i in range(n) if tags[i]) + sum(links[a, b] for a, b in zip(tags, tags[1:])))
            weight += w
            hits += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                twos[a, b] += w
        if n:
            want += list(hits / weight)
            want_pairs += twos / weight
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_windows_of_masked_words():
    got = pseudo_lm.windows([np.array([1, 2, 3]), np.array([], int), np.array([7])])
    pad = pseudo_lm._PAD
    assert got.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad, pad, pad, pad]]


def test_quotes_are_parsed():
    text = "Yes.\n\nOn Monday A wrote:\n> one\n> On Sunday B wrote:\n>> two\n> three\nNo."
    assert quotes.parse(text) == ("Yes.\n\nNo.", [(1, "one"), (2, "two"), (1, "three")])
    assert quotes.parse(None) == ("", []) and quotes.parse("> > a\n>b") == ("", [(2, "a"), (1, "b")])


def test_network_gradients():
    r = np.random.default_rng(4)
    flat = pseudo_lm.start_parameters(r.integers(0, 50, pseudo_lm.CLASSES)).astype(np.float64)
    window, wanted = r.integers(0, pseudo_lm.SLOTS + 2, (9, 4)), r.integers(0, pseudo_lm.CLASSES, 9)
    loss = lambda: -np.log(pseudo_lm.forward(flat, window)[2][np.arange(9), wanted]).mean()
    grad = pseudo_lm.gradients(flat, window, wanted)
    first = 0
    for shape in pseudo_lm._SHAPES:
        size = int(np.prod(shape))
        at = first + int(np.abs(grad[first : first + size]).argmax())
        first += size
        keep, ends = flat[at], []
        for step in (1e-5, -1e-5):
            flat[at] = keep + step
            ends.append(loss())
        flat[at] = keep
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-6 + 1e-4 * abs(grad[at])


def test_tree_over_every_piece_and_odd_white_space():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own, r = byte_bpe.Ranks(path, public_tokenizers.PATTERN, leaf=1), random.Random(8)
    pieces = {"".join(r.choice("etaoinshrdlu ") for _ in range(r.randrange(2, 30))) for _ in range(3000)} | {"x" * 500, "the" * 90}
    for piece in pieces:
        data = piece.encode()
        half = len(data) // 2
        assert own.join(own.encode_bytes(data[:half]), own.encode_bytes(data[half:])) == library._core_bpe.encode_single_piece(data)
    for _ in range(4000):
        text = "".join(r.choice([" ", "  ", "\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", "a", "B1", "'s", ".", "é"]) for _ in range(r.randrange(1, 9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_pooling_is_the_mean_over_all_bytes():
    r = np.random.default_rng(6)
    model = lang_gru.Tagger(["a", "b", "c"])
    model.out = r.standard_normal(model.out.shape).astype(np.float32)
    many = ["short", None, "²½ Ⅷ ①", "", "l" * 200 + " mixed text é" * 9, "x"]
    label, score = lang_gru.predict(model, many, group=2)
    assert label[1] == label[3] == "und" and lang_gru.predict(model, ["²½ ①", "_9_", "ª"])[0][:2] == ["und", "und"]
    for i in (0, 4, 5):
        data, total = many[i].encode(), np.zeros(3)
        for at in range(0, len(data), lang_gru.WINDOW):
            part = data[at : at + lang_gru.WINDOW].ljust(lang_gru.WINDOW, b"\0")
            probs = model.tag(np.frombuffer(part, np.uint8)[:, None])
            total += probs[: len(data) - at, :, 0].sum(0)
        total /= len(data)
        assert label[i] == "abc"[int(total.argmax())] and abs(score[i] - total.max()) < 1e-5


def test_regions_against_plain_windows():
    r = random.Random(5)
    for _ in range(300):
        lengths = [r.choice([0, 0, 0, 10, 30, 50, 90]) for _ in range(r.randrange(0, 25))]
        want, start = [], None
        for i in range(len(lengths)):
            total = sum(lengths[i : i + html_blocks.WINDOW])
            if start is None and total > 80 and lengths[i]:
                start = i
            elif start is not None and total == 0:
                want.append((start, i))
                start = None
        assert html_blocks.regions(lengths, 80) == want + ([(start, len(lengths))] if start is not None else [])


def test_pages_whose_marks_do_not_decide():
    long, noise = "many plain words in a row make a long line of the text " * 3, "<div class='ad'>buy</div>" * 4
    text = html_blocks.main_text
    assert text("<article><p title=don't>Hello there</p><p>it's fine</p></article>") == "Hello there it's fine"
    assert text('<p title="abc>Hello') == "Hello" and text("<p a='x>y' b=\"1>2\">t") == "t"
    # a marked teaser isn't the main text; a page of several marked articles has all of them
    assert text(f"<article><a href=x>More</a></article><div><h1>Head</h1><p>{long}</p></div>") == f"Head {long.strip()}"
    assert text(f"<main><article><p>{long}</p></article>{noise}<article><p>{long}</p><p>End.</p></article></main>") == f"{long.strip()} {long.strip()} End."
    # short text of the element that holds the main text stays, however far off
    assert text(f"<div><p>Start.</p>{noise}<p>{long}</p>{noise}<p>End.</p></div><div><p>Other</p></div>") == f"Start. {long.strip()} End."
    assert text(f"<div><section><p>{long}</p></section>{noise}<section><p>{long}</p></section><section><p>Short</p></section></div>").endswith("Short")
    assert text("<article>" + "<p>Hi.</p><div class='ad'>x</div>" * 3 + "</article><p>outside") == "Hi. Hi. Hi."
    assert len(text("<div><p>" + "word " * 400_000 + "</p></div>")) == 5 * 400_000 - 1


def test_words_keep_their_places():
    text = "İİİ you IDIOT"
    assert toxic_crf.words(text)[-2:] == ["you", "idiot"] and len(toxic_crf.words(text)) == 3
    assert toxic_crf.words(None) == toxic_crf.words("") == []
