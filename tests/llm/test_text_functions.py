"""The operators' functions on single texts, against plain versions."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import bpe, html_extract, license_scan, media, secret_scan, simhash, toxicity, warc

MANY = settings(max_examples=60, deadline=None)


# 1


def plain_base(text):
    found = []
    for k, (pattern, fits) in enumerate([
        (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(found)


@MANY
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", '"', " = ", ":", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "x9", "\n", "é", "="]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    base = plain_base(text)
    assert secret_scan.base_spans(text) == base
    assert [s for s in secret_scan.spans_of(text) if s[1] < 3] == base


KEY = "zX9k2LmQ8rT5vW1p"


@pytest.mark.parametrize(("text", "secret"), [
    (f'A = "{KEY}"\nB = A\ndb_password = B', KEY),
    (f'password = "{KEY}"', KEY),
    ("<password>h7G5f3D1s9A8</password>", "h7G5f3D1s9A8"),
    ("mysql --password p4ssW0rd!x9Z", "p4ssW0rd!x9Z"),
    ("tool -password p4ssW0rd!x9Z", "p4ssW0rd!x9Z"),
    ('{"private": {"signingKey": "q8W2e5R7t1Y4"}}', "q8W2e5R7t1Y4"),
    (f'private_key: str = "{KEY}"', KEY),
    (f"let privateKey: Optional[string] = '{KEY}';", KEY),
    (f'signing_key = ("{KEY}")', KEY),
    (f'signing_key = (\n  "{KEY}"\n)', KEY),
    (f'private_key = """{KEY}"""', KEY),
    ('signing_key = "zX9k2LmQ" + "8rT5vW1p"', 'zX9k2LmQ" + "8rT5vW1p'),
    (f'signing_key = os.getenv("SIGNING_KEY_NAME1", "{KEY}")', KEY),
    (f'const clientSecret = process.env.SECRET || "{KEY}";', KEY),
    (f'config["access_key"] = b"{KEY}"', KEY),
    (f'run("login --user=me credential={KEY}")', KEY),
    (f"Authorization: Bearer {KEY}", KEY),
    (f"PASSPHRASE={KEY}", KEY),
    (f"It's here, isn't it: credential = '{KEY}' don't", KEY),
])
def test_assigned_literals(text, secret):
    assert [text[a:b] for a, k, b in secret_scan.spans_of(text) if k == 3] == [secret]
    assert secret not in secret_scan.redacted_text(text)


@pytest.mark.parametrize("text", [
    "", "password: changeme", "the token = none", "Time: 12:30, note: this is prose", f'colour = "{KEY}"', "credential = config.database.primary_credential",
    'signing_key = os.getenv("SIGNING_KEY_NAME1")', "privateKey == otherKey", "private_key: str", "if credential: pass\nelse: go", '"' * 3, "'" * 3 + 'x: "',
])
def test_no_secrets(text):
    assert secret_scan.spans_of(text) == [] and secret_scan.redacted_text(text) == text


@pytest.mark.parametrize("part", ["a=", "a:b,", "x=f(", '"', "'", '"""', "a='", "token=", "--a ", "<a>", "x: y[", "\\", '="', "a=\"\\"])
def test_long_texts_without_blanks_take_linear_time(part):
    import time

    began = time.perf_counter()
    secret_scan.spans_of(part * (200_000 // len(part)))
    assert time.perf_counter() - began < 20


# 3


def plain_kneser_ney(corpus, ordinary, toxic):
    """word -> log-likelihood ratio, by the definition, over lists of words."""

    def grams(words, shortest):
        for w in words:
            padded = f"^{w}$"
            for end in range(2, len(padded) + 1):
                for size in range(shortest, toxicity.ORDER + 1) if shortest else [min(end, toxicity.ORDER)]:
                    if size <= end:
                        yield padded[end - size : end]

    before = {}
    for g in set(grams(corpus, 2)):
        before.setdefault(g[1:], set()).add(g[0])
    kinds = {g: len(x) for g, x in before.items()}
    held = [Counter(grams(words, 0)) for words in (ordinary, toxic)]

    def shared(gram):
        if not gram:
            return 1 / (sum(len(k) == 1 for k in kinds) + 1)
        beside = [n for k, n in kinds.items() if k[:-1] == gram[:-1]]
        if not beside:
            return shared(gram[1:])
        return (max(kinds.get(gram, 0) - 0.75, 0) + 0.75 * len(beside) * shared(gram[1:])) / sum(beside)

    def p(c, gram):
        beside = [n for g, n in held[c].items() if g[:-1] == gram[:-1]]
        if not beside:
            return shared(gram[1:])
        return (max(held[c][gram] - 0.75, 0) + 0.75 * len(beside) * shared(gram[1:])) / sum(beside)

    def ratio(word):
        padded = f"^{word}$"
        ends = [padded[max(0, e - toxicity.ORDER) : e] for e in range(2, len(padded) + 1)]
        return sum(math.log(p(1, g) / p(0, g)) for g in ends)

    return ratio


def test_words():
    assert toxicity.words_of("It's A1b — ÉTÉ_été²") == ["it", "s", "a", "b", "été", "été"]
    assert toxicity.words_of("ABC d3") == ["abc", "d"] and toxicity.words_of("") == []


def test_statistics():
    assert toxicity.statistics(np.array([])) == (0.0, 0.0, 0.0)
    assert toxicity.statistics(np.array([1.0, 3.0])) == (2.0, 2.0, 3.0)
    assert toxicity.statistics(np.array([0, 0, 5, 5, 0, 0, 0, 4.0])) == (1.75, 2.0, 5.0)


# 4


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@MANY
@given(st.lists(st.sampled_from(["A", "b", "É", " ", " ", "\n", "\x1c", "word", "  "]), max_size=40))
def test_fingerprint(parts):
    assert simhash.fingerprint("".join(parts).encode()) == plain_fingerprint("".join(parts))


def roots(codes, links):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("seed", range(25))
def test_gray_index_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 700))
    codes = rng.choice(rng.integers(0, 2**63, max(1, n // int(rng.integers(1, 60))), dtype=np.uint64), n)
    for _ in range(int(rng.integers(0, 7))):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    codes = np.unique(codes)
    i, j = np.nonzero(np.triu(simhash.popcount(codes[:, None] ^ codes[None, :]) <= 4, 1))
    want = roots(codes.tolist(), [(int(codes[a]), int(codes[b])) for a, b in zip(i, j)])
    links = simhash.index_links(codes)[0].tolist()
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < len(codes)
    assert roots(codes.tolist(), links) == want
    # Block by block: each index finds all links whose ends agree in its block, together they find every one.
    every, monkey = [], simhash.FRONT
    try:
        simhash.FRONT = 50  # the front goes down the tree in many pieces
        for mask in map(simhash.unsigned, simhash.cuts_of(0, 4)):
            found = simhash.index_links(codes, 4, mask)[0].tolist()
            agree = [(int(codes[a]), int(codes[b])) for a, b in zip(i, j) if not (int(codes[a]) ^ int(codes[b])) & mask]
            ends = roots(codes.tolist(), found)
            assert all(ends[a] == ends[b] for a, b in agree) and all((a ^ b).bit_count() <= 4 for a, b in found)
            every += found
    finally:
        simhash.FRONT = monkey
    assert roots(codes.tolist(), every) == want


def test_gray_index_drops_groups():
    """Of 20,000 random codes nearly all pairs go with a node far above them."""
    codes = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000, dtype=np.uint64))
    for mask in map(simhash.unsigned, simhash.cuts_of(0, 4)):
        links, dropped = simhash.index_links(codes, 4, mask)
        leaves = -(-len(codes) // simhash.LEAF)
        assert len(dropped) == 5 and all(dropped[1:4])
        assert sum(dropped) < 64 * len(codes) < leaves * len(codes) / 10


def test_gray_order_changes_one_bit():
    ranks = simhash.gray_rank(np.arange(256, dtype=np.uint64))
    order = np.argsort(ranks)
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:]))


# 5

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="cookie-notice">We use</div>
<article><h1>Head &amp; tail</h1><p><b>One<br>two<p>Three <span class="share">x</span>four<script>var t="</p>";</script><aside>Side</aside>
<div id="comments"><p>Nice!</div></article><form>F</form><footer>f</footer>"""


def test_declared_article():
    assert html_extract.main_text(html_extract.blocks_of(PAGE)) == "Head & tail\nOne two\nThree four"


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>t</title><body><article><p>One</article>", "One"),
    ("<head><meta charset=x><p>loose", "loose"),
    ("<article><p title=it's>One</p><p>Two don't</p></article>", "One\nTwo don't"),
    ('<article><div class="article-header"><h1>Title</h1></div><header><p>Standfirst</header><p>Body</article>', "Title\nStandfirst\nBody"),
    ('<div class="page has-sidebar"><article><p>Body</p></article><div class="sidebar">x</div></div>', "Body"),
    ('<article class="post social" id="ad-7"><p>Body</article><article class="comment"><p>No!</article>', "Body"),
    ("<article><p>a<script/>y</script>b</p></article>", "ab"),
    ("<article><p>a <button>x</button><svg><path/></svg>b <select><option>1</select>c</article>", "a b c"),
    ("<article><p>1 < 2 <b>and</b> 3 <4</p></article>", "1 < 2 and 3 <4"),
    ("<main><p>a</p><p>b<span title=\"x>y\">c</span></p><p>cut <a href='", "a\nbc\ncut"),
    ("<article><p>a<!-- > <p> -->b</p><!-- open <p>c</article>", "ab"),
    ("<article><p>a<textarea>t<b></textarea>b<iframe>q</iframe></p></article><footer>f", "ab"),
])
def test_pages_with_odd_marks(html, want):
    assert html_extract.main_text(html_extract.blocks_of(html)) == want


@pytest.mark.parametrize("part", ['<a"', "<a", "<a ='", '<p x="', "</", "<!--", "<script>", "<textarea>", "<div>", "</div>", "<p>x", "&amp", "<article><div class=ad>", "<", "<a =\n", "<b =x '>"])
def test_malformed_pages_take_linear_time(part):
    import time

    began = time.perf_counter()
    html_extract.blocks_of(part * (300_000 // len(part)))
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(("html", "want"), [
    ('<article><p>Intro</p><section id="related-work"><p>Others have</p></section><div class="share-price">12 a share</div></article>', "Intro\nOthers have\n12 a share"),
    ('<article><p>Intro</p><div class="related-posts"><p>More</p></div><div class="post share-buttons">Tweet</div></article>', "Intro"),
    ("<article>" + "<div>" * 300 + "<p>Deep</p></article><div>Loose after</div>", "Deep"),
])
def test_names_and_depth_inside_articles(html, want):
    assert html_extract.main_text(html_extract.blocks_of(html)) == want


def test_undeclared_page_keeps_unique_runs():
    blocks = html_extract.blocks_of("<div>a b c d e f g h</div><p>own words</p>")
    assert html_extract.main_text(blocks) == "a b c d e f g h\nown words"
    words = [text.split(" ") for _, text in blocks]
    assert html_extract.unique_text(words, [True, True], [0]) == "own words" and html_extract.unique_text(words, [True, False], None) == "a b c d e f g h"
    assert html_extract.main_text([]) == ""


@MANY
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), min_size=1, max_size=5))
def test_suffix_classes(streams):
    order, classes, stream = html_extract.suffix_classes(streams)
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
    grams = {}
    for place, c in zip(order.tolist(), classes.tolist()):
        s = streams[stream[place]]
        gram = tuple(s[place - starts[stream[place]] :][: html_extract.RUN])
        assert (c >= 0) == (len(gram) == html_extract.RUN)
        if c >= 0:
            assert grams.setdefault(c, gram) == gram
    assert len(set(grams.values())) == len(grams)


# 6


@MANY
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % media.WIDTH == 0 and len(payload) >= media.WIDTH
    assert media.from_png(media.to_png(payload)) == payload and payload.startswith(data)


def test_members_are_retried_by_offset(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0-1.png", b"one")
        z.writestr("1-2.png", b"two")
    infos = [(i.header_offset, i.file_size, i.CRC) for i in zipfile.ZipFile(path).infolist()]
    calls = []

    def opened():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("away")
        return pa.OSFile(str(path))

    assert media.with_retries(opened, infos[1], "a", pause=0) == b"two" and len(calls) == 3
    path.write_bytes(path.read_bytes().replace(b"two", b"twx", 1))
    with pytest.raises(OSError, match="member at"):
        media.with_retries(lambda: pa.OSFile(str(path)), infos[1], "a", pause=0)
    assert media.with_retries(lambda: pa.OSFile(str(path)), infos[0], "a", pause=0) == b"one"


# 7


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_bpe_equals_the_library(vocabulary):
    pieces, decoder = bpe.pieces_of(vocabulary), bpe.decoder_of(vocabulary)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.machine.ranks, special_tokens={})
    split, rng = bpe.splitter(public_tokenizers.PATTERN), random.Random(5)
    letters = [*"abcdeéßñ 12$'\n\t", "日本", "😀", "́", "\xa0", "²", "t", "ing", "ción", "<|endoftext|>", " " * 9]
    texts = ["", "a" * 5000, " " * 3000, "ab" * 2000] + ["".join(rng.choices(letters[: rng.randint(2, len(letters))], k=rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = b"".join(map(pieces.__getitem__, split(text)))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text


def test_narrow_split_equals_the_pattern():
    fast, slow, rng = bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall, random.Random(2)
    assert public_tokenizers.PATTERN == bpe.COMMON
    for _ in range(5000):
        text = "".join(chr(rng.randrange(256)) if rng.random() < 0.5 else rng.choice(" 'stmdrevl\n1a") for _ in range(30))
        assert fast(text) == slow(text)


def test_caches_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    pieces = bpe.Pieces(bpe.parsed_ranks(vocabulary))
    words = [f" wort{i}xyz" for i in range(200)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.machine.ranks, special_tokens={})
    assert [np.frombuffer(pieces[w], "<u4").tolist() for w in words] == [library.encode_ordinary(w) for w in words]
    assert len(pieces) <= 10 and len(pieces.machine.paths) < 80 and len(pieces.machine.pairs) <= 20


def test_borders_equal_merging(vocabulary):
    """Undoing merges tells what merging both tokens' joined bytes tells, and settled stretches of a long piece join."""
    tables = bpe.compiled(bpe.parsed_ranks(vocabulary))
    machine, rng = bpe.Transducer(tables), random.Random(4)
    assert tables.ordered
    joined, found = [i for i, half in enumerate(tables.first) if half != bpe.NONE], 0
    for _ in range(5000):
        left, right = rng.choice(joined[: rng.choice([40, 400, 4000])]), rng.randrange(rng.choice([300, 3000]))
        if right < 256 or tables.first[right] != bpe.NONE:
            want = bpe.merged(machine.bytes_of[left] + machine.bytes_of[right], tables.ranks) == [left, right]
            assert machine.apart(left, right) == want
            found += not want
    assert found > 100
    piece = "".join(rng.choices("abcdefgnirst", k=3 * bpe.BLOCK)).encode()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tables.ranks, special_tokens={})
    assert machine.encode(piece) == library.encode_ordinary(piece.decode())


def test_recurring_words_are_determinised_once(vocabulary):
    """As many words as a task meets: coming back to them makes no set again."""
    pieces, rng = bpe.pieces_of(vocabulary), random.Random(6)
    words = [" " + "".join(rng.choices("abcdefghilmnoprstuvw", k=8)) for _ in range(40_000)]
    first = [pieces.machine.encode(w.encode()) for w in words]
    assert len(pieces.machine.paths) > 80_000
    made = len(pieces.machine.paths)
    assert [pieces.machine.encode(w.encode()) for w in words] == first and len(pieces.machine.paths) == made


@MANY
@given(st.text(max_size=30), st.integers(1, 5))
def test_utf8_stream(text, step):
    stream, data = bpe.Utf8Stream(), text.encode("utf-8", "replace")
    out = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.finish()
    assert out == data.decode()


def test_utf8_stream_marks_what_is_cut():
    stream = bpe.Utf8Stream()
    assert stream.feed("é".encode()[:1]) == "" and stream.finish() == "�"


# 9


def test_size_bounds_lose_nothing():
    for row in license_scan.template_rows(0.8):
        n = len(row["grams"])
        for a in range(1, 3 * n + 5):
            if 2 * min(a, n) / (a + n) >= 0.8:
                assert row["lo"] <= a <= row["hi"]


def test_anchors_miss_no_match():
    words = set(license_scan.anchors(0.8))
    for row, (_, text) in zip(license_scan.template_rows(0.8), license_scan.TEMPLATES):
        own = license_scan.template_words(text)
        without = {p for p in zip(own, own[1:]) if not words & set(p)}
        assert 2 * len(without) / (len(without) + len(row["grams"])) < 0.8
    assert len(words) < 80 and not words & {"the", "of", "and", "to", "in", "is"}


# 10


def test_warc_records():
    out = io.BytesIO()
    payloads = [(1, "http://a/ü?x=1\n", b"", None), (None, None, "ä" .encode() * 50_000, None), (3, "u", b"x\r\n\r\ny", 1)]
    for p in payloads:
        out.write(gzip.compress(warc.record(*p, "2024-01-01T00:00:00Z")))
    found = list(warc.read_records(io.BytesIO(out.getvalue())))
    assert [r["page_id"] for r in found] == [1, None, 3] and [r["payload_bytes"] for r in found] == [0, 100_000, 6]
    assert found[2]["record_type"] == "revisit" and found[2]["refers_to"] == 1
    assert found[1]["payload_digest"] == base64.b32encode(hashlib.sha1(payloads[1][2]).digest()).decode()


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"payload", None, "d")
    for bad in (good.replace(b"payload", b"pazload"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good[:-3]):
        with pytest.raises((ValueError, EOFError)):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises((EOFError, zlib.error)):
        list(warc.read_records(io.BytesIO(gzip.compress(good)[:-12])))


KEY = "Zk4Qw8Lm2Rt7Xv9B"


@pytest.mark.parametrize("text", [
    f'#define PRIVATE_KEY "{KEY}"', f'client.setPassword("{KEY}")', f'private_key, x = "{KEY}", 1', f'x, private_key = 1, "{KEY}"', f'client_secret = KEY\nKEY = "{KEY}"', f'token_name = B\nB = C\nC = "{KEY}"',
    f'options.put("api_key", "{KEY}");', f'setattr(self, "client_secret", "{KEY}")', f"a = '{{\"b\": \"c = `client_secret: {KEY}`\"}}'", "very_" * 60 + f'secret_key = "{KEY}"', 'client_secret = getenv("A", ' + "(1), " * 100 + f'"{KEY}")',
])
def test_literals_without_bounds(text):
    assert [text[a:b] for a, b in secret_scan.literal_spans(text)] == [KEY]


def test_no_part_of_a_joined_literal_is_left():
    text = "private_key = " + " + ".join(f'"{KEY}{i:02d}"' for i in range(200))
    assert KEY not in secret_scan.redacted_text(text)


@pytest.mark.parametrize("part", ["a=(", "f(a=", 'x="a"+', "a, b = ", "set(", "f(a=f(", "k=b\n", "a.setToken(", "a=b,", '"a: \\"', "a:b|", "x = y or "])
def test_lexer_takes_linear_time(part):
    import time

    began = time.perf_counter()
    secret_scan.spans_of(part * (60_000 // len(part)))
    assert time.perf_counter() - began < 5
