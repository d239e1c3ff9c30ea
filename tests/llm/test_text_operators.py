import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weekloom.llm import bpe, secrets
from weekloom.llm.html_text import blocks, common, extract_main_text, main_text
from weekloom.llm.language import identify_languages
from weekloom.llm import toxicity
from weekloom.llm.toxicity import score_toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OWN = bpe.Vocabulary(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aabcé ñ1\n😀'st", max_size=60))
def test_bpe_equals_tiktoken(text):
    assert bpe.encode_text(text, bpe.regex.compile(public_tokenizers.PATTERN), OWN) == TIKTOKEN.encode_ordinary(text)
    pieces = bpe.regex.findall(public_tokenizers.PATTERN, text)
    assert [i for x in OWN.encode_many([p.encode() for p in pieces if p]) for i in x.tolist()] == [i for p in pieces for i in OWN.encode_piece(p.encode())] or any(p.encode() in RANKS for p in pieces)


def test_bpe_on_long_pretokens_and_rows(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("etaoinsh") for _ in range(60000))
    texts = {1: "Hello world's  best", 2: None, 3: "", 4: long, 5: "a" * 30000, 6: "  \n\n x", 7: "thion thion thion"}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in texts.items():
        want = TIKTOKEN.encode_ordinary(t or "")
        assert list(rows[i].ids) == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in texts.items()}
    assert bpe.bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def plain_scan(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "=", ":", " ", '"', "abc", "AKIA", "ABCD1234", "0a1b2c3d", "é", "%41", "\\u0041", "Secret"]), max_size=14).map("".join))
def test_base_scan_equals_plain(text):
    base, every = secrets.find_secrets(text)
    assert sorted(base) == plain_scan(text) and set(base) <= set(every)


def held_in(n):
    """How many base64 characters hold the first n bytes."""
    return -(-n * 4 // 3)


def test_layers_map_back_to_the_text():
    def spans(text):
        return secrets.find_secrets(text)[1]

    inner = base64.b64encode(SECRET.encode()).decode()
    text = f"é {inner} end"
    assert (2, 2 + held_in(SECRET.index('"', 9)), "assign") in spans(text)  # the characters that hold the find, up to the closing quote
    zipped = base64.b64encode(gzip.compress(zlib.compress(SECRET.encode()))).decode()
    assert any(k == "hex" for _, _, k in spans(f"x {zipped} y"))
    twice = base64.b64encode(base64.b64encode(SECRET.encode())).decode()
    assert any(k == "assign" for _, _, k in spans(twice))
    url = "q password%3Dabcdef123 z"
    assert spans(url) == [(2, 22, "assign")]
    uni = "q \\u0070assword=abcdef123 z"
    assert (2, 25, "assign") in spans(uni)
    assert secrets.redacted(url, "#") == "q # z"
    assert spans("A" * 4000) == [] and spans("") == []


def test_layers_that_are_not_clean_text():
    def kinds(text):
        return {k for _, _, k in secrets.find_secrets(text)[1]}

    code = lambda x: base64.b64encode(x).decode()
    for data in (f"cle :\u00a0 {SECRET}".encode(), f"\ufeff{SECRET}".encode(), SECRET.encode() + b"\0\xff", SECRET.encode("utf-16"), b"\0" + SECRET.encode("utf-16-be")):
        assert kinds(f"x {code(data)} y") >= {"assign", "hex"}
    inner = code(SECRET.encode()).rstrip("=")
    for prefix in ("https://h.example/data/", "x-", "id_", "ab/"):
        at = len("é " + prefix)
        assert (at, at + held_in(len(SECRET) - 1), "assign") in secrets.find_secrets(f"é {prefix}{inner} end")[1]
    for packed in (gzip.compress(SECRET.encode()), gzip.compress(b"one") + gzip.compress(SECRET.encode()), gzip.compress(bytes(9 << 20) + SECRET.encode())):
        lines = re.findall(".{1,20}", code(packed))
        assert kinds("a\n" + "\n".join(lines) + "\nb") >= {"assign", "hex"} and kinds(f"id_{code(packed)}") >= {"assign", "hex"}
    assert kinds("\n".join(re.findall(".{1,14}", code(SECRET.encode())))) >= {"assign", "hex"}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["abc", "é ", "😀", "\n", " ", SECRET, "api_key=abcdef99", "AKIA" + "Z9" * 9]), min_size=1, max_size=9), st.sampled_from([0, 20, 61]), st.sampled_from(["", "q", "id_", "ab"]))
def test_spans_of_finds_in_base64_equal_a_naive_map(parts, width, prefix):
    hidden = " ".join(parts)
    run = prefix + base64.b64encode(hidden.encode()).decode().rstrip("=")
    text = "é " + ("\n".join(run[i : i + width] for i in range(0, len(run), width)) if width else run) + " ."
    place = [i for i, c in enumerate(text) if c not in "é .\n"]  # of each character of the run
    if len(place) < 16:
        return
    offset = lambda i: len(hidden[:i].encode())
    want = {(place[len(prefix) + offset(a) * 4 // 3], place[len(prefix) - (-offset(b) * 4 // 3) - 1] + 1, kind) for a, b, kind in plain_scan(hidden)}
    assert want <= set(secrets.find_secrets(text)[1])
    assert len({x for x in want if x[2] == "assign"}) == sum(k == "assign" for *_, k in plain_scan(hidden))  # a span for each


def test_long_runs_and_edges_of_blocks(monkeypatch):
    import time

    lines = "\n".join(f"line {i:06d} of a log" for i in range(190_000))  # 5 MB
    run = "q" + base64.b64encode((lines[:3_700_000] + SECRET).encode()).decode()
    began = time.time()
    assert any(k == "assign" for _, _, k in secrets.find_secrets(f"x {run} y")[1]) and time.time() - began < 20
    many = base64.b64encode("\n".join(f"key {i:040x}" for i in range(2000)).encode()).decode()
    assert len([1 for *_, k in secrets.find_secrets(f"x q{many}")[1] if k == "hex"]) == 2000
    monkeypatch.setattr(secrets, "BLOCK", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ,.") for _ in range(n))
    code = lambda x: base64.b64encode(x).decode()
    for before in (0, 3000, 4090, 9000):
        nested = code((noise(20_000).replace(",", "/") + SECRET + noise(9000)).encode())  # a run over many blocks
        assert any(k == "assign" for *_, k in secrets.find_secrets("x " + code(gzip.compress((noise(before) + " , " + nested + " , " + noise(5000)).encode())))[1])
        for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
            inner = noise(before).encode() + b"\x00\x01hd" + pack((noise(6000) + SECRET).encode()) + noise(6000).encode()
            assert any(k == "assign" for *_, k in secrets.find_secrets("x " + code(gzip.compress(inner)))[1]), (before, pack)


def test_deeply_nested_escapes_are_linear():
    import time

    for levels in (1, 3, 17, 40, 60_000):
        text = "x p%" + "25" * levels + "61ssword=abcdef123 y"
        began = time.time()
        assert (3, len(text) - 2, "assign") in secrets.find_secrets("x " + text[2:])[1] or any(k == "assign" and b == len(text) - 2 for a, b, k in secrets.find_secrets(text)[1])
        assert time.time() - began < 3


def naive_layers(text, depth=3):
    """Every layer of a text whose whole is encoded."""
    out = {text}
    for _ in range(depth):
        for t in list(out):
            for decode in (lambda x: base64.b64decode(x, validate=True), lambda x: gzip.decompress(base64.b64decode(x, validate=True)), lambda x: re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), x).encode()):
                try:
                    out.add(decode(t).decode("utf-8"))
                except Exception:  # noqa: BLE001
                    continue
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["base64", "gzip", "url"]), min_size=1, max_size=3), st.integers(10**9, 10**12))
def test_layers_equal_a_naive_decoder(steps, number):
    text = f'config token = "{number}abcdef" end'
    for step in steps:
        raw = text.encode()
        text = base64.b64encode(raw).decode() if step == "base64" else base64.b64encode(gzip.compress(raw, mtime=0)).decode() if step == "gzip" else "".join(f"%{b:02X}" for b in raw)
    want = any(k == "assign" for t in naive_layers(text) for _, _, k in plain_scan(t))
    assert want and any(k == "assign" for _, _, k in secrets.find_secrets(text)[1])


def test_secret_rows(spark):
    df = spark.createDataFrame([(1, SECRET, 0), (2, None, 0), (3, "", 0), (None, "AKIA" + "B" * 16, 0)], "doc_id long, text string, n_hex int")
    rows = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex) == (1, 0, 1)
    assert rows[1].base_sha256 == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest() and rows[1].spans == "assign:0:49,hex:9:49"
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[None].n_access == 1
    assert [r.text for r in secrets.redact_secrets(df).orderBy("text").collect()] == [None, "", "[secret]", '[secret]"']
    assert secrets.scan_secrets(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav><div class="ad">Buy</div>
<main><article><h1>Head &amp; more</h1><p><b>One <i>two</i> &nbsp;three<br><p>Four<script>var t="</p>";</script> five<ul><li>x<li>y</ul><aside>side</aside><form>f</form>
<section id="comments"><p>nice</p></section></article></main><footer>&copy; c</footer>"""


def test_blocks_of_a_page():
    assert blocks(PAGE) == [(True, "Head & more"), (True, "One two three"), (True, "Four five"), (True, "x"), (True, "y")]
    assert blocks("") == [] and blocks("a < b &am") == [(False, "a < b &am")]
    assert blocks("<p>cut <a hre") == [(False, "cut")]


def test_lcs_and_differencing(spark):
    assert common([1, 2, 3, 4], [2, 9, 4]) == {1, 3} and common([], [1]) == set()
    assert main_text([(False, "menu"), (False, "own"), (False, "end")], None) == "menu\nown\nend"
    page = lambda own: f"<div>Shared top</div><p>{own}</p><div>Shared end</div>"
    rows = [(1, "http://h.x/a/1", page("alpha")), (2, "http://h.x/a/2", page("beta")), (3, "http://g.x/a/1", page("gamma")), (4, None, None), (5, "http://h.x/z", PAGE), (5, "http://h.x/z", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.text) for r in extract_main_text(df).collect())
    article = "Head & more\nOne two three\nFour five\nx\ny"
    assert [g for g in got if g[0] >= 3] == [(3, "Shared top\ngamma\nShared end"), (4, ""), (5, article), (5, article)]
    assert {t for i, t in got if i < 3} <= {"alpha", "beta", "Shared top\nalpha\nShared end", "Shared top\nbeta\nShared end"}
    assert extract_main_text(df.limit(0)).count() == 0


def test_copies_and_ranges_of_one_host(spark):
    page = lambda own: f"<div>Shared top</div><p>{own}</p><div>Shared end</div>"
    own = ["alpha", "beta", "beta", "beta", "beta", "gamma", "gamma", "delta", *[f"own {i}" for i in range(30)]]
    df = spark.createDataFrame([(i, f"http://h.x/a/{i:03}", page(t)) for i, t in enumerate(own)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in extract_main_text(df).collect()} == dict(enumerate(own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pages_with_an_article_are_differenced(spark):
    page = lambda own, menu: f"<nav><a>{menu}</a></nav><article><h1>{own}</h1><p>quoted line</p></article><p>Shared end</p><footer>&copy; h.x</footer><span class='ad'>Buy</span>"
    rows = [(1, "http://h.x/a/1", page("alpha", "m1")), (2, "http://h.x/a/2", page("beta", "m2")), (3, "http://h.x/a/3", page("beta", "m3")), (4, "http://g.x/a/1", page("gamma", "m4"))]
    got = {r.page_id: (r.text, r.n_shared, r.n_restored) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # shared: the quoted line, which stays, and the end, the footer and the advert, which go
    assert got == {1: ("alpha\nquoted line", 4, 1), 2: ("beta\nquoted line", 4, 1), 3: ("beta\nquoted line", 4, 1), 4: ("gamma\nquoted line", 0, 0)}


def test_languages_on_held_out_rows(spark):
    rng = random.Random(5)
    words = {"en": "the and of with this from that".split(), "de": "der und nicht mit von ein für".split(), "fr": "les est dans pour une avec très".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x, "s") for i in range(300) for x in [rng.choice(list(words))]]
    rows += [(1000, None, "en", "s"), (1001, "12 ** ..", "en", "s"), (1002, "", None, "s"), (None, "the and of", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify_languages(df).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert identify_languages(df.limit(0)).count() == 0


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(200)]
    rude = ["worthless", "worthles", "worthlesss", "wortthless", "pathetic", "pathetik", "patheticc", "pathettic"]
    texts, marks = [], []
    for i in range(900):
        bad = i % 4 == 0
        own = rng.sample(plain, 10) + (rng.sample(rude, 2) if bad else [])
        rng.shuffle(own)
        texts.append((i, " ".join(own), 0.5))
        marks.append((i, int(bad), 1))
    texts += [(9000, None, 0.5), (9001, "", 0.5)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string, score double"), spark.createDataFrame(marks + [(5000, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert 0 <= got[9000].score == got[9001].score <= 1
    assert score_toxicity(docs, labels.limit(0)).where("score <> 0.5").count() == 0 and score_toxicity(docs.limit(0), labels).count() == 0


def plain_logit(text, worth, rest):
    """Word by word and n-gram by n-gram; an n-gram's slot is looked up by the code under test."""
    words = "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in text.lower()).split()
    total = 0.0
    for w in words:
        marked = f" {w} "
        grams = [marked[i : i + n] for n in toxicity.ORDERS for i in range(len(marked) - n + 1)]
        slots = [int(s) for g in grams for s, at in zip(*toxicity.ngrams(np.array([ord(c) for c in g], dtype=np.uint32)), strict=True) if at == 0 and len(g) >= 3][: 10**6]
        by_length = [toxicity.ngrams(np.array([ord(c) for c in g], dtype=np.uint32))[0][-1] for g in grams]
        assert slots
        total += np.mean(worth[by_length])
    return rest + total / max(1, len(words))


def test_toxicity_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(1)
    worth = rng.normal(size=toxicity.SLOTS).astype(np.float32)
    texts = ["one two", "", "a", "  x  ", "Ünïcode worthless, trash!", "word " * 50, "1 2 3", "q" * 3000, "中文字符没有空格", "a-b c'd"]
    got = toxicity.logits(texts, worth, 0.5)
    assert np.allclose(got, [plain_logit(t, worth, 0.5) for t in texts], atol=1e-4)
    small, toxicity.TOGETHER = toxicity.TOGETHER, 10
    try:
        assert np.allclose(got, toxicity.logits(texts, worth, 0.5))
    finally:
        toxicity.TOGETHER = small


def test_toxicity_of_repeated_ids_and_labels(spark):
    texts = [(i, "vile nasty words here" if i % 2 else "calm gentle words here", None) for i in range(60)]
    docs = spark.createDataFrame(texts + [(0, "zzz other", None), (None, "vile nasty", None)], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0), (None, 1), (1, 1)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 62 and sum(r.doc_id == 0 for r in rows) == 2 and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert all(r.score > 0.5 for r in rows if r.doc_id and r.doc_id % 2) and all(0 <= r.score <= 1 for r in rows)
