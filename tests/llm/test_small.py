"""Small cases of the text preparation operators: nulls, empties, ties, repeats, long texts, clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wishgrid.llm import decontaminate, html_text, langid, line_dedup, mixing, neighbours, order_minhash, substring_dedup, token_files, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d long, id string, key string, w string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 7, "i", "k", "w") if len(r) == 4 else r for r in rows], DOCS)


def frame(df, *key):
    return sorted((tuple(r) for r in df.select(*key).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{k % 97}x{k}" for k in range(30_000))
    return docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "Ab", None, None), (3, "Ab", None, None), (None, "same line of five words\nsame line of five words", "de", "a"), (4, long, "en", None), (5, long, "en", "b")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/en/1?x"), (2, "https://example.org/es/a"), (3, "http://org"), (4, None), (5, "no scheme"), (6, "http://x.com/fr/#y"), (6, "http://x.com/fr/#y"), (7, "ftp://notexample.org/es/")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), (None, "block")], "rule string, verdict string")
    got = frame(url_filter.judge_urls(pages, rules, "block"), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([
        (1, "a.example.org", "/en/1", "example.org/en/1", "block"), (2, "example.org", "/es/a", "example.org/es/", "block"), (3, "org", "", None, "block"),
        (4, "", "", None, "block"), (5, "", "", None, "block"), (6, "x.com", "/fr/", "com/fr/", "allow"), (6, "x.com", "/fr/", "com/fr/", "allow"), (7, "notexample.org", "/es/", "org/", "allow")], key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_mix(spark, odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 7 and all(0 <= r.copies <= 2 for r in got)
    assert mixing.mix_sources(none).count() == 0
    rows = [(k, "w " * (k % 50 + 1), "en", f"s{0 if k % 3 else k % 7}") for k in range(3000)]
    many = docs(spark, rows)
    a, b = (frame(mixing.mix_sources(many, part_rows=n), "doc_id", "copies") for n in (64, 64))
    assert a == b
    per = mixing.mix_sources(many, part_rows=64).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 51 for r in per)
    mixed = mixing.mix_sources(many)
    assert mixing.emit_copies(many, mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_copies_of_rows_with_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else k % 10, f"w{k // 3} " * (k % 7 + 1), "en", f"s{k % 3}" if k % 4 else None) for k in range(300)]
    table = docs(spark, rows + rows[:20])
    mixed = mixing.mix_sources(table).localCheckpoint()
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = mixing.emit_copies(table, mixed).collect()
    assert collections.Counter(r.source for r in got) == taken
    words = {r.source: (r.n, r.target) for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("target")).collect()}
    for source, (n, target) in words.items():
        assert sum(len(r.text.split()) for r in got if r.source == source) == n and abs(n - target) <= 8


def brute_hits(text, items, window=13):
    words = decontaminate_words(text)
    hit, found = set(), set()
    for item, value in items:
        own = decontaminate_words(value)
        n = min(window, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("bound", [200_000, 3])
def test_contamination(spark, odd, none, bound):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(12)] + ["É", "ß9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(99, None), (None, "v1 É ß9 v1")]
    texts = [(k, ", ".join(rng.choices(vocabulary, k=25)) + " " + (items[k % 12][1] or "").upper().replace("É", "É") + " end") for k in range(30)]
    table = docs(spark, [(k, t, "en", "s") for k, t in texts] + [(0, texts[0][1], "en", "s"), (50, None, None, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.contamination(table, bench, set_windows=bound).collect()}
    for k, t in texts:
        n, hit, found = brute_hits(t, items)
        assert got[k] == (n, hit, [f for f in found if f != "None"]), k
    assert got[50] == (0, 0, [])
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 7
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    marks, seen = [bytearray(len(b)) for b in data], {}
    for r, b in enumerate(data):
        for s in range(len(b) - length + 1):
            first = seen.setdefault(b[s : s + length], (r, s))
            if first != (r, s):
                for x, y in (first, (r, s)):
                    marks[x][y : y + length] = b"\1" * length
    return [(len(b), sum(m), len(bytes(m).replace(b"\0", b" ").split()), hashlib.sha256(bytes(c for c, f in zip(b, m, strict=True) if not f)).hexdigest()) for b, m in zip(data, marks, strict=True)]


@pytest.mark.parametrize("together", [20_000, 2])
def test_repeated_strings(spark, none, together):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    shared = [word(k) for k in (199, 200, 201, 260, 500)]
    texts = [None, "", "short", "a" * 700, "ab" * 400] + [word(rng.randrange(300)) + rng.choice(shared) + word(rng.randrange(200)) + rng.choice(shared)[rng.randrange(60):] for _ in range(40)]
    texts += [texts[6], texts[7], texts[8][:-3] + "zzz"]
    got = substring_dedup.remove_repeats(docs(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(44, texts[44], None, None)]), together).collect()
    texts.append(texts[44])
    told = brute_repeats(texts)
    want = collections.Counter((min(k, 44) if k == len(texts) - 1 else k, *told[k]) for k in range(len(texts)))
    assert collections.Counter(tuple(r) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("together", [20_000, 2])
def test_short_runs_between_unique_texts(spark, together):
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcde \n", k=150)) + c * n + "".join(rng.choices("abcde \n", k=150)) for c in "-=_*#.+~" for n in (150, 190)]
    got = substring_dedup.remove_repeats(docs(spark, [(k, t, None, None) for k, t in enumerate(texts)]), together).collect()
    assert sorted(tuple(r) for r in got) == [(k, *told) for k, told in enumerate(brute_repeats(texts))]


def test_merge_sort_is_lexicographic():
    rng = np.random.default_rng(1)
    group, keys = rng.integers(0, 9, 500), rng.integers(-1, 3, (500, 12)).astype(np.int16)
    order, _ = substring_dedup.merge_sorted(group, keys)
    got = [(g, *k) for g, k in zip(group[order].tolist(), keys[order].tolist(), strict=True)]
    assert got == sorted(got)


def test_lines(spark, odd, none):
    got = {(r.doc_id, r.n_units, r.n_removed, r.chars_removed): [tuple(s) for s in r.spans] for r in line_dedup.repeated_units(odd).collect()}
    assert got[(None, 2, 1, 23)] == [(24, 23)]
    assert (1, 0, 0, 0) in got and (2, 1, 0, 0) in got and (3, 1, 0, 0) in got
    assert [k for k in got if k[0] == 5][0][2] == 1
    assert line_dedup.repeated_units(none).count() == 0
    cut = {r.doc_id: r.text for r in line_dedup.without_spans(odd, line_dedup.repeated_units(odd)).collect()}
    assert cut[None] == "same line of five words\n" and cut[5] == "" and cut[1] is None


def test_language(spark, odd, none):
    words = {"en": "the and of house water", "de": "der und das haus wasser", "fr": "le et la maison eau"}
    rng = random.Random(3)
    table = docs(spark, [(k, " ".join(rng.choices(words[g].split(), k=20)), g, g) for k in range(240) for g in [list(words)[k % 3]]])
    model = langid.fit(table)
    told = langid.identify(table, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in told)
    rest = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und")} <= rest
    assert langid.identify(none, model).count() == 0 and langid.fit(none).predict("abc") == ("und", 0.0)
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_html(spark):
    page = '<nav>menu</nav><!-- x --><div class="ad">buy</div><article><h1>T &amp; t</h1><p>a\n<b>b</b>c<br>d<p>e&nbsp;f<script>"</p>"</script><section class="comments"><p>me</section></article><footer>c</footer>'
    rows = [(1, "u", page), (2, "u", None), (2, "u", ""), (3, None, "plain words"), (4, "u", "<p>" + "x " * 200_000 + "</p><a href="), (5, "u", "<div>menu</div>" * 0 + "<ul><li><a>home</a></ul><p>" + "text " * 30 + "<p>tail")]
    table = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(table).collect()}
    assert (1, "T & t\n\na bc d\n\ne f", 18) in got and (2, "", 0) in got and (3, "plain words", 11) in got
    assert {n for i, _, n in got if i == 4} == {399_999}
    assert (5, "text " * 29 + "text\n\ntail", 155) in got
    assert html_text.extract_text(table.limit(0)).count() == 0


def test_html_small_article():
    text = "".join(f"<div><p>{'main text ' * 20}{k}</div>" for k in range(4))
    blocks = html_text.main_blocks(f"<body>{text}<article><h2>teaser</h2></article></body>")
    assert [b.split()[-1] for b in blocks][:4] == ["0", "1", "2", "3"]
    assert html_text.main_blocks(f"<body><article>{text}</article><div>{'other ' * 30}</div></body>") == blocks[:4]


def test_html_short_blocks():
    long = "<div><div><p>" + "long text " * 20 + "</p></div></div>"
    own = "".join(f"<div><div><p>short {k}</p></div></div>" for k in range(3))
    rows = "<table>" + "".join(f"<tr>\n <td>cell {k}</td>\n</tr>" for k in range(3)) + "</table>"
    menu = "<nav><ul>" + "<li><a href='/'>go</a></li>" * 6 + "</ul></nav>"
    want = ["short 0", "short 1", "short 2", "cell 0", "cell 1", "cell 2"]
    for page in (long + own + rows + long, long + menu + own + rows + menu + long):
        blocks = html_text.main_blocks(f"<body>{page}</body>")
        assert blocks[1:-1] == want and blocks[0] == blocks[-1] == ("long text " * 20).strip()
    assert html_text.main_blocks(f"<body><p>top</p>{menu}{long}{menu}<p>end</p></body>") == [blocks[0]]


@pytest.mark.parametrize("start, end", [
    ("<main class='content has-sidebar'>", "</main>"), ("<article class='post no-comments'>", "</article>"), ("<div id='page' class='with-header'>", "</div>"),
    ("<form action='/'><input>", "</form>"), ("<div title='The hidden coast'>", "</div>"), ("<div class='widget'><main>", "</main></div>"), ("<article id='comments'>", "</article>"),
    ("<div class='social'>", "</div>"), ("<div class='social'><form><div>", "</div></form></div>"),
])
def test_html_wrapped_text(start, end):
    text = "".join(f"<p>{'text ' * 20}{k}</p>" for k in range(3))
    want = [f"{'text ' * 20}{k}" for k in range(3)]
    page = f"<body>{start}{text}{end}<div class='sidebar ad'>buy</div><div hidden>not shown</div><div style='display: none'>nor this</div><form>search <input></form></body>"
    assert html_text.main_blocks(page) == want
    assert html_text.main_blocks("<div class='ad'>buy this and that</div><article><p>short</article>") == ["short"]


def test_near_duplicates(spark, odd, none):
    rng = random.Random(4)
    words = [f"q{k}" for k in range(400)]
    rows, group = [], {}
    for g in range(30):
        base = rng.choices(words, k=120)
        for c in range(1 if g % 3 else 6):
            own = base[:]
            if c:
                own[rng.randrange(120)] = f"n{g}{c}"
            rows.append((len(rows), " ".join(own), "en", "s"))
            group[len(rows) - 1] = g
    for large in (16, 1):
        got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs(spark, rows), large=large).collect()}
        first = {}
        for k, g in group.items():
            assert got[k] == first.setdefault(g, k)
    classes = {(r.doc_id, r.class_id) for r in order_minhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (None, None)} <= classes
    assert frame(order_minhash.keep_one(odd), "doc_id") == sorted([(1,), (3,), (None,), (4,)], key=repr)
    assert order_minhash.near_duplicates(none).count() == 0


def test_crowded_buckets_compare_on_all_bands(spark, monkeypatch):
    words = [f"q{k}" for k in range(400)]
    hashes = np.array([r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.hash("w").alias("h")).collect()])
    rng, late = np.random.default_rng(12), []
    for _ in range(20_000):
        own = rng.integers(0, 400, 50)
        other = own.copy()
        other[25] = (own[25] + 1) % 400
        x, y = (order_minhash.shingles(hashes[v]) for v in (own, other))
        common = np.flatnonzero(order_minhash.band_keys(x) == order_minhash.band_keys(y))
        if len(common) and common[0] >= 14 and order_minhash.similarity(x, y) >= order_minhash.LEAST:
            late.append((own, other))
        if len(late) == 2:
            break
    assert len(late) == 2
    monkeypatch.setattr(order_minhash, "STARS", 0)
    rows = [(k, " ".join(words[w] for w in own), None, None) for k, own in enumerate(v for pair in late for v in pair)]
    assert {(r.doc_id, r.class_id) for r in order_minhash.near_duplicates(docs(spark, rows), large=1).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2)}


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(40):
        x = order_minhash.shingles(rng.integers(0, 50, 60))
        y = x[rng.random(len(x)) > 0.05]
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        best = table[-1, -1]
        assert order_minhash.similarity(x, y) == pytest.approx(best / (len(x) + len(y) - best))


@pytest.mark.parametrize("bits", [1, 8])
def test_tokens(spark, odd, none, bits, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    library = Tokenizer.from_file(path)
    texts = [None, "", " a  b", "x.y, z.\nNew line", "tab\there", "<|endoftext|>", "it's 12,5 é. ü,", "\n\n", "word," * 3, "a .b ,c"]
    table = docs(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    token_files.write_tokens(table, str(tmp_path / f"t{bits}"), plane_bits=bits, chunk=8)
    start = 0
    for r in sorted(token_files.read_tokens(spark, str(tmp_path / f"t{bits}"), with_ids=True).collect(), key=lambda r: r.doc_id):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert token_files.round_trip(odd).count() == 7 and token_files.round_trip(none).count() == 0


def test_pieces_like_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    letters = list("abcdeéßñÿÆıøɐλжы漢،0129'’.,-$@\u0301\u00a0\n ") + [" "] * 8
    texts = ["".join(rng.choice(letters, rng.integers(1, 300))) for _ in range(400)]
    texts += [" ".join(t.split()) for t in texts]
    monkeypatch.setattr(token_files, "REMEMBERED", 500)
    for k in range(0, len(texts), 50):
        for t, got in zip(texts[k : k + 50], token_files.encode(texts[k : k + 50], path), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_planes():
    ids = np.random.default_rng(0).integers(0, 2**32, 1000, np.uint64).astype("<u4")
    for bits in (1, 8):
        assert (token_files.from_planes(token_files.to_planes(ids, bits), 1000, bits) == ids).all()


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    own = rng.standard_normal((900, 24)).astype(np.float32)
    own[300:600] = own[300]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(own)] + [(None, own[0].tolist(), 1), (5000, None, 1), (5050, [0.0] * 24, 1), (5100, [float("nan")] * 24, 1), (5150, [None] * 24, 1), (5200, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest_neighbours(table).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    x = own.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(900), -np.round(score, 12)))[:5]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert all(s == pytest.approx(score[v]) for v, s in got[q])
    assert hits >= 0.9 * 5 * 18 and set(got) == set(range(0, 900, 50))
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0


def test_pipeline_functions(spark, sf, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_files"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    before = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == table.columns, name
        before = after.limit(60) if name == "language_id" else after
