"""Page text, languages, leaks, licences and secrets, against brute force and planted cases."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import urllib.parse
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeflow.llm import decontam, htmltext, langid, licences, secrets


def docs(spark, found, schema="doc_id long, text string"):
    return spark.createDataFrame(found, schema)


# -- pages -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A&amp;B</h1><p>one<b>two</b> \n three<br>x<p>Ti.</article><footer>no</footer>", "A&B onetwo three x Ti."),
        ("<nav>menu</nav><main>a<aside>no</aside><form>no</form>b</main>", "a b"),
        ('<article>a<div class="ad-box">no</div><section id="comments"><p>no</section><p hidden>no</p>b</article>', "a b"),
        ("<article>a<script>if (1 < 2) '</p>'</script><style>p{}</style><!-- no -->b</article>", "a b".replace(" ", "")),
        ("<article>a &lt;p&gt; &#233;&nbsp;b < c</article>", "a <p> é b < c"),
        ("<article><header><h1>Title</h1></header>a</article><header>site</header>", "Title a"),
        ("<article><p title=it's>a</p><p>b", "a b"),
        ("<nav><a href=x>only</a></nav>", ""),
    ],
)
def test_articles(page, text):
    assert htmltext.main_text(page) == text


def test_line_blocks_find_the_text_without_an_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4)) + "<p>Short.</p>" + f"<p>{'end ' * 30}</p>"
    page = "<div>Home</div><ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul>" + body + "<ul>" + "<li><a href=x>more</a></li>" * 9
    text = htmltext.main_text(page + "</ul><div>Imprint</div>")
    assert text.startswith("word word") and text.endswith("end end") and "Short." in text
    assert "link" not in text and "Imprint" not in text
    assert htmltext.spans([0, 5, 100, 0, 3, 100, 0, 0, 0, 9], 3, 86) == [(1, 6)]


BODY = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(4))
TEXT = " ".join(f"{'word ' * 30}{i}." for i in range(4))


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="layout has-sidebar"><article>{BODY}</article></div>', TEXT),
        (f'<div class="content no-sidebar"><article>{BODY}</article></div>', TEXT),
        (f'<div class="content no-sidebar">{BODY}</div><div class="sidebar">{BODY}</div>', TEXT),
        (f"<main>{BODY}<ul>" + "<li><a href=x>one of many</a></li>" * 9 + "</ul></main>", TEXT),
        (f"<main>{BODY}<p><a href=x>source</a></p>{BODY}</main>", f"{TEXT} source {TEXT}"),
        # Short lines of the element that holds the text count, longer ones outside it don't.
        (f"<p>{'some words outside ' * 6}</p><article><h1>A</h1>{BODY}<p>b</p></article><div>Printed in 2020</div>", f"A {TEXT} b"),
    ],
)
def test_density_decides_and_elements_weigh(page, text):
    assert htmltext.main_text(page) == text


def test_a_teaser_does_not_hide_the_article():
    page = f'<div>{BODY}</div><section class="more-stories"><article><h3>Teaser title</h3></article></section>'
    assert htmltext.main_text(page).startswith(TEXT)


@pytest.mark.parametrize(
    "page",
    ["<span>" * 120_000 + "<p>x y z" * 120_000, "<div>" * 150_000 + "</b>" * 250_000 + "text", "<p>" + "a < b &amp; " * 180_000, "<li><a href='x" * 140_000],
)
def test_long_pages_take_time_in_proportion(page):
    assert len(page) > 1_600_000
    begun = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - begun < 10


def test_page_query(spark, sf):
    def brute(page):
        import html

        inside = re.search("<article>(.*)</article>", page or "", re.S)
        text = re.sub(r"</?(p|h1|br)>", " ", inside[1]) if inside else ""
        return " ".join(html.unescape(re.sub("<[^>]*>", "", text)).split())

    given_ = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    want = sorted((i, u, brute(h), len(brute(h))) for i, u, h in given_)
    assert sorted(tuple(r) for r in htmltext.op1_html(spark, sf).collect()) == want
    odd = docs(spark, [(None, None, None), (1, "u", "<article>a</article>"), (1, "u", "<article>a</article>")], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in htmltext.extract(odd.withColumn("text", F.lit(1))).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert htmltext.extract(odd.limit(0)).count() == 0


# -- languages --------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    found, n, _ = langid.matcher()
    rng = np.random.default_rng(5)
    chances = rng.random((n + 1, 2)) * 1e-3
    number = {p: found.get(p)[0] for p in found.keys()}

    def brute(word, k):
        word, sums = "▁" + word, [1.0] + [0.0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in number:
                    sums[end] += sums[start] * chances[number[word[start:end]], k]
            if word[end - 1] not in number:
                sums[end] += sums[end - 1] * chances[n, k]
        return np.log(sums[-1])

    words = ["then", "schön", "日x本", "a"]
    assert np.allclose(langid.log_chances(words, chances), [[brute(w, k) for k in range(2)] for w in words])
    long_ = langid.log_chances(["ab" * 500], chances)
    assert np.isfinite(long_).all()
    # Expected counts of letters add up to the letters there are.
    counts = langid.expected(["then", "schön"], np.array([[2.0, 0.0], [0.0, 3.0]]), chances)
    sizes = np.array([len(p) for p, _ in sorted(number.items(), key=lambda x: x[1])] + [1])
    assert np.allclose(sizes @ counts, [10.0, 18.0])


def test_languages(spark, sf):
    rows = langid.op10_langid(spark, sf).collect()
    given_ = {i: (t, lang) for i, t, lang in duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()}
    assert len(rows) == len(given_)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == given_[r["doc_id"]][1] for r in rows if r["held_out"]]
    assert len(held) > 30 and np.mean(held) >= 0.97


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string"
    taught = docs(spark, [(1, "der die das und ist nicht", "de"), (3, "the and that with this", "en"), (4, None, "en"), (5, "x", None)], schema)
    model = langid.learn(taught)
    assert model.languages == ("de", "en")
    odd = docs(spark, [(None, "the that"), (1, None), (1, "123 !"), (2, ""), (2, "und nicht"), (2, "und nicht")])
    got = langid.identified(odd.withColumn("score", F.lit("old")).withColumn("extra", F.lit(1)), model)
    assert got.columns == ["doc_id", "text", "extra", "lang_pred", "score"]
    assert sorted(("~" if r["text"] is None else r["text"], r["lang_pred"]) for r in got.collect()) == [
        ("", "und"), ("123 !", "und"), ("the that", "en"), ("und nicht", "de"), ("und nicht", "de"), ("~", "und"),
    ]
    assert langid.accepted(odd, model).count() == 3 and langid.accepted(odd, model).columns == odd.columns
    nothing = langid.learn(taught.limit(0))
    assert {tuple(r)[-2:] for r in langid.identified(odd, nothing).collect()} == {("und", 0.0)}
    assert langid.identified(odd.limit(0), model).count() == 0


# -- leaks ------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=8), st.lists(st.integers(0, 4), max_size=12))
def test_alignment(item, words):
    scores = np.zeros((len(item) + 1, len(words) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            hit = decontam.MATCH if item[i - 1] == words[j - 1] else decontam.MISMATCH
            scores[i, j] = max(0, scores[i - 1, j - 1] + hit, scores[i - 1, j] - 1, scores[i, j - 1] - 1)
    score, first, last = decontam.align(np.array(item, np.int64), np.array(words, np.int64))
    assert score == scores.max()
    if score:
        assert decontam.align(np.array(item), np.array(words[first : last + 1]))[0] == score
    assert decontam.align_long(np.array(item, np.int64), np.array(words, np.int64))[0] == score


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def edited(step):
    return " ".join("changed" if i % step == step - 1 else w for i, w in enumerate(ITEM.split()))


def test_leaks(spark):
    filler = "some ordinary words that nobody asks about "
    found = [
        (1, filler + ITEM.upper() + ". " + filler), (2, filler * 3), (3, filler + edited(6) + " " + filler), (None, ITEM), (4, None), (5, ""),
        (6, ITEM.replace("kappa", "kappa and something more")), (7, " ".join(ITEM.split()[::-1])), (1, filler + ITEM), (8, "alpha beta gamma delta only"),
        *[(100 + i, filler * 200 + ITEM) for i in range(20)],
    ]
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, ""), (10, ITEM)], "item_id long, text string")
    df = docs(spark, found).withColumn("mark", F.lit(1)).withColumn("item_id", F.lit("x"))
    got = decontam.leaks(df, bench).collect()
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    assert ids == sorted([1, 1, 3, -1, 6, *range(100, 120)])
    assert {r["item_id"] for r in got} == {10}
    first = next(r for r in got if r["doc_id"] == 1 and r["last_word"] < 30 and r["score"] == 1.0)
    assert (first["first_word"], first["last_word"]) == (7, 26)
    sliced = decontam.leaks(df, bench, at_once=5).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, got))
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8]
    assert decontam.leaks(df.limit(0), bench).count() == decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.without_leaks(df, bench.limit(0)).count() == len(found)


@pytest.mark.parametrize("n, copies", [(30, 1), (300, 3)])
def test_edited_copies_are_found_by_the_grams_they_keep(spark, n, copies):
    words = [f"word{i}" for i in range(38)]
    changed = " ".join("changed" if i in (5, 11, 17, 23, 29) else w for i, w in enumerate(words))
    found = [(i, f"ordinary text {i} " + (changed if i < copies else "without a copy")) for i in range(n)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontam.leaks(docs(spark, found), bench).collect()
    assert {(r["doc_id"], round(r["score"], 2)) for r in got} == {(i, 0.8) for i in range(copies)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=4, max_size=9), st.lists(st.sampled_from("abcdex"), max_size=14))
def test_no_item_that_aligns_well_is_ruled_out(item, words):
    items = decontam.Items([1, 2], [" ".join(item), "p q r s"], 4)
    coded = np.array([items.numbers.get(w, 0) for w in words], np.int64)
    score = decontam.align(items.items[0][1], coded)[0] / (decontam.MATCH * len(item))
    assert score < decontam.SIMILAR or 0 in items.sharing(coded, decontam.SIMILAR)


def test_leak_query(spark, sf):
    given_ = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    exact = {(i, b) for i, t in given_ for b, x in items if t and x in t}
    rows = decontam.op4_decontamination(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["score"] == 1.0} >= exact
    words = lambda t: [w for w in decontam.words_of(pa.array([t])).to_pylist()[0] if w]
    texts, asked = dict(given_), dict(items)
    for r in rows:
        part = words(texts[r["doc_id"]])[r["first_word"] : r["last_word"] + 1]
        same = len(set(part) & set(words(asked[r["item_id"]]))) / len(set(part))
        assert r["score"] >= decontam.SIMILAR and same > 0.5


# -- licences ----------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for label, phrase in licences.BASE.items():
        cut = phrase.split()
        places += [(k, label) for k in range(len(words) - len(cut) + 1) if words[k : k + len(cut)] == cut]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places}))


def test_licences(spark, tmp_path):
    texts = [
        "Released UNDER the MIT-License. under the mit license", "Apache License, Version 2.0", "cc-by NC", "İ under the mit license K",
        "mit", "", None, "é-under, the\n\nmit   license9", "licensed under the gnu general public license version 3", "all " * 3000,
        "under the mit license apache license version 2 cc by nc " * 3, "version 2 apache license", "CC BY NC 4.0 Licensed under",
    ]
    found = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    docs(spark, found).withColumn("words", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    df = licences.op6_licences(spark, str(tmp_path))
    rows = df.collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows)
    assert got == sorted(str((i, *brute_base(t))) for i, t in found)
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["labels"] == "gpl-3" and by[8]["score"] == 1.0 and by[9]["score"] == 0.0
    assert by[10]["labels"] == "apache-2,cc-by-nc,mit"
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licences.scan_licences(docs(spark, [])).count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licence_query(spark, sf):
    given_ = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rows = licences.op6_licences(spark, sf).collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows)
    assert got == sorted(str((i, *brute_base(t))) for i, t in given_)


# -- secrets -----------------------------------------------------------------------------------


def brute_secrets(text):
    text, found = text or "", []
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" if c == "?" else c for c in w) for w in ("password", "passwd", "secret", "token", "api?key"))
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


PARTS = ["password", "PassWD", "api_key", "ſecret", "toKen", "=", ": ", '"', "'", " ", "abcdefgh", "12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "日", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_kinds(text):
    base, every = secrets.find_secrets(text)
    assert base == brute_secrets(text) and set(base) <= set(every)


SECRET = "password=hunter2hunter2"


def wraps():
    enc = lambda b: base64.b64encode(b).decode()
    url = "".join(f"%{b:02x}" for b in SECRET.encode())
    uni = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    yield "url", url
    yield "double url", urllib.parse.quote(url)
    yield "unicode", uni
    yield "entities", "".join(f"&#{ord(c)};" for c in SECRET)
    yield "base64", enc(SECRET.encode())
    yield "gzip", enc(gzip.compress(SECRET.encode() * 3))
    yield "zlib", enc(zlib.compress(SECRET.encode()))
    yield "deep", enc(gzip.compress(enc(uni.encode()).encode()))
    yield "hex", SECRET.encode().hex()


@pytest.mark.parametrize("name, wrapped", list(wraps()))
def test_wrapped_secrets(name, wrapped):
    text = f"é日 before {wrapped} after"
    base, every = secrets.find_secrets(text)
    kinds = [(a, b) for k, a, b in every if k == "assign"]
    assert kinds and all(10 <= a < b <= 10 + len(wrapped) for a, b in kinds)
    assert "[assign]" in secrets.redacted(text) and secrets.redacted(text).startswith("é日 before ")


def parts_of_layers():
    enc = lambda b: base64.b64encode(b).decode()
    for n in range(98, 110):
        yield f"wrapped {n}", base64.encodebytes(b"x " * 49 + b" " * (n - 98) + b"password=abcd1234").decode()
    for kind in (gzip, bz2, lzma):
        yield kind.__name__, enc(kind.compress(b"a") + kind.compress(SECRET.encode()))
    one = zstandard.ZstdCompressor().compress
    yield "zstd", enc(one(b"a") + one(SECRET.encode()))
    yield "nested", enc(bz2.compress(b"a ") + bz2.compress(enc(one(b"c ") + one(SECRET.encode())).encode()))
    for kind in (bz2, lzma):
        yield f"{kind.__name__} beyond the limit", enc(kind.compress(b"a " * 2_000_000 + SECRET.encode()))
    for before in ("path/", "a-b-", "key_", "user/files_"):
        yield f"after {before}", before + enc(SECRET.encode())
    yield "between", "path/" + enc(SECRET.encode() * 3).rstrip("=") + "_name/of-it"


@pytest.mark.parametrize("name, wrapped", list(parts_of_layers()))
def test_layers_are_opened_to_their_end(name, wrapped):
    text = f"before\n\n{wrapped}\n\nafter"
    base, every = secrets.find_secrets(text)
    assert not base and [k for k, _, _ in every] == ["assign"]
    assert "abcd1234" not in secrets.redacted(text) and secrets.redacted(text).startswith("before")


def test_a_word_after_a_blob_is_no_part_of_it():
    blob = base64.b64encode(b"password=hunter2hunter22").decode()
    assert secrets.redacted(f"x {blob}\nafter y") == "x [assign]\nafter y"


def test_spans_map_character_by_character():
    text = "x%20pass%77ord%3Dabcdefghij%20y"
    _, every = secrets.find_secrets(text)
    assert every == [("assign", 4, 27)]


def test_circles_end_and_clean_text_stays():
    assert secrets.find_secrets("%25" * 50 + "25")[1] == []
    for text in (None, "", "plain words only", "100%25 sure &amp; fine \\u0041", "A" * 400, base64.b64encode(b"nothing here at all").decode()):
        assert secrets.find_secrets(text) == ([], []) and secrets.redacted(text) == text


def test_secret_tables(spark, sf):
    given_ = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in secrets.op7_secrets(spark, sf).collect()}
    for doc_id, text in given_:
        base, r = brute_secrets(text), rows[doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for x, _, _ in base) for k in secrets.KINDS]
        assert r["base_sha256"] == hashlib.sha256(secrets.shown(base).encode()).hexdigest()
    odd = docs(spark, [(None, SECRET), (1, None), (1, ""), (1, SECRET), (1, SECRET)])
    assert sorted(len(r["spans"]) for r in secrets.scan_documents(odd.withColumn("spans", odd.text)).collect()) == [0, 0, 1, 1, 1]
    fresh = secrets.redact_documents(odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("base", F.lit(1)))
    assert {(r["text"], r["n_chars"], r["base"]) for r in fresh.collect()} == {("[assign]", 8, 1), (None, None, 1), ("", 0, 1)}
    assert secrets.scan_documents(odd.limit(0)).count() == 0


PLAIN = "password=abcd1234"


@pytest.mark.parametrize(
    "data",
    [
        "é café ".encode("latin-1") + PLAIN.encode() + " déjà".encode("latin-1"),
        f"x {PLAIN} end".encode("utf-16-le"),
        f"x {PLAIN} end".encode("utf-16-be"),
        b"\x00\x01\xfe\x02\x9f" + PLAIN.encode(),
        bytes(range(128, 256)) + PLAIN.encode() + bytes(range(256)),
    ],
    ids=["latin-1", "utf-16-le", "utf-16-be", "five bytes", "binary"],
)
def test_bytes_that_are_not_all_text(data):
    encoded = base64.b64encode(data).decode()
    for text in (encoded, base64.b64encode(gzip.compress(data)).decode(), data.hex(), "q" + encoded, "qq" + encoded, "qqq" + encoded, f"a/b_c/{encoded}"):
        base, every = secrets.find_secrets(f"see {text} .")
        kinds = [k for k, a, b in every if (k, a, b) not in base]
        assert kinds and set(kinds) == {"assign"}, text
        assert all(4 <= a < b <= 4 + len(text) for _, a, b in every)


@pytest.mark.parametrize("part", ["-", "/", "a/", "AAAA/", "abcd-efgh_", "x_"])
def test_long_runs_take_time_in_proportion(part):
    def took(n):
        begun = time.process_time()
        assert secrets.find_secrets(part * (n // len(part)))[1] == []
        return time.process_time() - begun

    took(10_000)
    assert took(240_000) < 8 * took(60_000) + 1
