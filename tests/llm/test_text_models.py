"""Decontamination, language model, page text, quality and packing: brute force, held-out rows, round trips, odd rows."""

import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from settings import SF

from riskloom.llm import decontaminate, html_text, packing, pitman_yor, quality


def test_decontamination_query(spark, same_as_sql):
    same_as_sql(decontaminate.op4_decontaminate(spark, SF), decontaminate.OP4_SQL)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 2), (400, 3), (300, 50)):
        words = rng.integers(0, k, n)
        order = decontaminate.suffix_array(words, 8)
        keys = [tuple(words[i : i + 8]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
    same = decontaminate.suffix_array(np.zeros(1000, int), 1000)
    assert same.tolist() == list(range(999, -1, -1))


def brute(text, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w, hit, found = word.findall(lower(text)), set(), set()
    for key, body in items:
        v = word.findall(lower(body))
        size = min(width, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit |= {*range(i, i + size)}
                found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(7)
    text = lambda n, k: " ".join(f"w{i}" for i in rng.integers(0, k, n))
    items = [(i, text(int(rng.integers(1, 30)), 3)) for i in range(8)] + [(90, ""), (91, None), (92, "É À w1"), (93, "one two"), (93, "w1 w2 w1 w1 w0 w2 w1 w0 w2 w2 w1 w0 w1 w1")]
    docs = [(i, text(int(rng.integers(0, 120)), 3)) for i in range(30)] + [(100, None), (101, ""), (102, "x É à w1 y ONE, two"), (102, "x É à w1 y ONE, two"), (103, items[0][1])]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):  # one block of the benchmark, and several passes
        got = decontaminate.judged(decontaminate.benchmark_matches(d, b, block_bytes=block)).collect()
        want = {k: brute(t, items) for k, t in docs}
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id] and r.words == "c"
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0 and decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)


def test_longest_match_and_place(spark):
    item = " ".join(f"q{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"a b {item} c"), (2, " ".join(item.split()[3:18]))], "doc_id long, text string")
    got = {r.doc_id: [(m.item_id, m.item_start, m.start, m.words) for m in r.matches] for r in decontaminate.benchmark_matches(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {1: [("5", 0, 2, 20)], 2: [("5", 3, 0, 15)]}


def test_language_model(spark):
    import collections

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pitman_yor.op7_lm_score(spark, SF).collect()}
    tokens = {k: [*t.encode().lower().split(), None] for k, t in docs.items()}
    train = {k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2}
    count = collections.Counter(w for k in train for w in tokens[k])
    n, v = sum(count.values()), len(count)
    for k, t in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in count for w in t), n, k not in train)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b a", "x"), (3, "a b a", "x"), (None, "A b", None)], "doc_id long, text string, score string").drop("score")
    got = pitman_yor.score_texts(docs, docs.where("doc_id < 3")).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in got] == [1, 1, 3, 4, 4] and got[0].score == got[1].score and got[3].score == got[4].score
    assert pitman_yor.score_texts(docs, docs.limit(0)).where("score < 0").count() == 5
    assert pitman_yor.score_texts(docs.limit(0), docs).count() == 0


def test_language_model_is_its_formula_where_nothing_is_drawn(spark):
    """Learned from p q r alone: every pair and word occurs once, so each has one table; discounts are 0.9 and 0.5."""
    rows = [(1, "p q r"), (2, "q p"), (3, "z p"), (4, "p q"), (5, "p q"), (6, "P  q R")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    word, unknown = (0.5 + 3 / 5) / 5, 3 / 5 / 5  # of the parent; four of one and one of the other sum to one
    once, never, new = (0.1 + 1.9 * word) / 2, 1.9 * word / 2, 1.9 * unknown / 2
    want = {1: [once] * 4, 2: [never] * 3, 3: [new, word, never], 4: [once, once, never], 5: [once, once, never], 6: [once] * 4}
    for train in (docs.where("doc_id = 1"), docs.doc_id == 1):
        got = {r.doc_id: r.score for r in pitman_yor.score_texts(docs, train).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], sum(map(math.log10, p)), rel_tol=1e-9) for k, p in want.items())


def test_language_model_learns_pairs_of_rare_words(spark):
    """Each of 5,000 words has a share below 2^-11 and all end alike; what follows one is learned for every one of them."""
    lines = [" ".join(f"{c}{i:04}ab" for c in "xy") for i in range(2500)]
    learned = [(k, "\n".join(lines[(i * 7 + k) % 2500] for i in range(2500))) for k in range(3)]
    asked = [(k, f"x{i:04}ab y{j:04}ab") for k, (i, j) in enumerate([(17, 17), (17, 18), (2400, 2400), (2400, 2399)])]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(table(asked), table(learned)).collect()}
    assert len(got) == 4 and got[0] - got[1] > 2 and got[2] - got[3] > 2


def test_seats_are_drawn_from_their_distribution():
    c, others, p, d, n = 7, 4, 0.3, 0.6, 40_000
    s = np.exp(pitman_yor.log_stirling(c, d))[c, 1:]
    weight = np.array([s[t - 1] * math.prod((1 + d * (others + k)) * p for k in range(t)) for t in range(1, c + 1)])
    stirling = pitman_yor.log_stirling(pitman_yor.EXACT, d)
    seeds = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, n)
    drawn = pitman_yor.seat(np.full(n, c), np.full(n, others), np.full(n, p), d, 1.0, stirling, seeds)
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.01)


def test_predictive_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(3)
    counts = spark.createDataFrame([(int(u), int(w), int(c)) for u in range(6) for w, c in zip(rng.choice(40, 15, False), rng.integers(1, 400, 15), strict=True)], "u int, w int, c long")
    p = 10.0 ** pitman_yor.averaged_predictive(counts, 40).astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p > 0).all()


def test_stirling_numbers():
    got = np.exp(pitman_yor.log_stirling(4, 0.5))
    assert np.allclose(got[3, 1:4], [0.5 * 1.5, 3 * 0.5, 1])
    assert np.allclose(got[4, 4], 1)


def test_matches_of_repeated_windows_stay_small():
    import tracemalloc

    from riskloom.llm.common import NOT_WORD, Words

    windows = decontaminate.Windows(["same " * 300, "a b c", "x " + "same " * 14], 13)
    tracemalloc.start()
    found = decontaminate.shard_matches(Words([b"same " * 20_000 + b"y", b"z a b c", b"x " + b"same " * 13], NOT_WORD), windows)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (1, 1, 1, 0, 3) in found and (2, 0, 2, 0, 14) in found
    covered = {p for d, start, item, _, n in found if d == 0 and item == 0 for p in range(start, start + n)}
    assert covered == {*range(20_000)} and max(n for *_, n in found) == 300


def test_decontamination_of_a_long_text(spark):
    text = "benchmark words of one item that stand in a row here and go on ".split()
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 9999}" for i in range(150_000)) + " " + " ".join(text))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(text))], "item_id long, text string")
    r = decontaminate.judged(decontaminate.benchmark_matches(docs, items)).first()
    assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (150_000 + len(text), len(text), ["7"], False)


def test_page_text_structure():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><!-- x --><div class='ad box'>Buy</div>"
        "<article><header><h1>Head &amp; line</h1></header><p>One<br>two\n three.<p><b>Four</b> five&nbsp;six</p><aside>Side</aside><form>Mail</form><div class=\"comments\"><p>Nice!</p></div></article><footer>Foot</footer>"
    )
    assert html_text.content(html_text.page_lines(page), None)[0] == ["Head & line", "One two three.", "Four five six"]
    assert html_text.page_lines("") == []
    assert [x[0] for x in html_text.page_lines("<p title=\"a > b\">One</p><p title = 'x>' y=it's>Two</p>x < y<script>a</script >z")] == ["One", "Two", "x < yz"]
    broken = "<p class=it's>One</p><p>Two</b></i><span>three</p>" + "<i>" * 20_000 + "</u>" * 20_000 + "four"
    assert [x[0] for x in html_text.page_lines(broken)] == ["One", "Twothree", "four"]


@pytest.mark.parametrize("piece", ["<a ", "<a '", "</script ", "<script><", "<!--", "<p class='", '<p a="" ', "<div>", "<b></i>", "&amp"])
def test_page_of_a_megabyte_is_read_in_one_pass(piece):
    began = time.time()
    for end in ("", ">", "'>", '">'):
        html_text.page_lines(piece * (1_000_000 // len(piece)) + end)
    assert time.time() - began < 20


def paired(rows):
    """By definition: each page's text when it is differenced against the reference of its nearest folder that has two."""
    import xxhash

    page_of = lambda h: (x := xxhash.xxh64_intdigest((h or "").encode(), 42)) - (1 << 64 if x >> 63 else 0)
    where = {}
    for key, url, html in rows:
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        where[key] = (host, ["/".join(path.split("/")[:i]) for i in range(1, max(len(path.split("/")), 2))][: html_text.LEVELS])
    out = {}
    for key, _, html in rows:
        host, folders = where[key]
        other = None
        for folder in reversed(folders if host else []):
            there = {page_of(h): h for k, _, h in rows if where[k][0] == host and folder in where[k][1]}
            if len(there) > 1:
                other = there[min(there) if min(there) != page_of(html) else max(there)]
                break
        lines = html_text.page_lines(html or "")
        shared = html_text.common_lines([x[0] for x in lines], [x[0] for x in html_text.page_lines(other)]) if other is not None else set()
        inside = any(x[2] and not x[1] for x in lines)
        whole = not inside and {i for i, x in enumerate(lines) if not x[1]} <= shared
        out[key] = "\n\n".join(x[0] for i, x in enumerate(lines) if not x[1] and (x[2] if inside else whole or i not in shared))
    return out


def test_page_differencing_against_brute_force(spark):
    page = lambda body: f"<div>Menu of the site</div><p>{body}</p><p>more of {body}</p><div>All rights reserved here</div>"
    rows = [(i, f"http://H{i % 2}.com/{'pq'[i % 3 % 2]}/{i}.html?x#y", page(f"text {i // 2 * 2}")) for i in range(24)]
    rows += [(30, "http://other.com/", page("lonely")), (31, None, page("a")), (32, "http://c.com/1", page("same")), (33, "http://c.com/2/", page("same")), (34, "http://h.com", page("root")), (35, "http://h.com/a/b/c", page("deep")), (36, "http://h.com/a/d", page("deep"))]
    rows += [(40, "http://m.com/" + "x/" * 40, page("far")), (41, "http://m.com/" + "x/" * 40, "<main><p>Menu of the site</p></main><p>Menu of the site</p>"), (42, "http://m.com/", None), (42, "http://m.com/", None), (43, "nothing", "<p>z</p>"), (44, "http://c.com/3", "")]
    want = paired(rows)
    assert want[0] == "text 0\n\nmore of text 0" and want[30].startswith("Menu") and want[41] == "Menu of the site" and want[32] == want[33] and want[42] == ""
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for slices in (1, 3, 50):
        got = [(r.page_id, r.text) for r in html_text.main_text(table.repartition(slices)).collect()]
        assert sorted(got) == sorted((r[0], want[r[0]]) for r in rows)
    assert html_text.main_text(table.limit(0)).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    import random

    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = [a[i] for i in sorted(html_text.common_lines(a, b))]
        it = iter(b)
        assert len(found) == table[-1][-1] and all(x in it for x in found)


def test_page_query(spark):
    rows = html_text.op8_html_text(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.n_chars > 100 for r in rows) > 0.9 * len(rows) and not any("<" in r.text[:50] for r in rows)


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert np.mean([got[k].predicted == labels[k] for k in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, rng.normal(0, 1, quality.FEATURES).astype(np.float32), rng.normal(0, 1, (quality.FEATURES, quality.RANK)).astype(np.float32))
    doc, place, value = quality.features([b"one two two THREE!!", b""])
    got = model.scores(2, doc, place, value)
    for k in (0, 1):
        p, x = place[doc == k], value[doc == k]
        z = model.w0 + (x * model.w[p]).sum() + sum(float(model.v[p[i]] @ model.v[p[j]]) * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert math.isclose(got[k], 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "l"), (2, "", "l"), (3, "a good text", "l"), (3, "a good text", "l"), (None, "x", "l")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == 5 and got[0].score == got[1].score
    blank = quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0)))
    assert blank.count() == 5 and quality.score_quality(docs.limit(0), quality.FactorisationMachine.fit([], np.zeros(0))).count() == 0


def test_encoder_equals_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "  a\n\n b\t", "É日本 <|endoftext|> 12345's", "a" * 3000]
    encode = packing.encoder()
    assert all(reference.encode(t, add_special_tokens=False).ids == encode(t) for t in texts)


def test_packing_ids_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext| > <|endofte", "plain words", ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.pack(docs, with_ids=True).collect()}
    assert got == {i: [*reference.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 0]


def test_packing_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_packing(spark, SF).collect()
    check_packing(rows, docs)


def check_packing(rows, docs):
    encode, total = packing.encoder(), 0
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {*by_doc} == {*docs}
    for k, text in docs.items():
        ids, at = [*encode(text), 0], 0
        total += len(ids)
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        for i, p in enumerate(pieces):
            assert (p.piece, p.start) == (i, at) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            assert i == 0 or p.length == packing.CAPACITY
            at += p.length
        assert at == len(ids) and (len(ids) > packing.CAPACITY or len(pieces) == 1)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= 1.1 * total / packing.CAPACITY + 3


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 5000, 0), (3, "again", 0)], "doc_id long, text string, piece int")
    rows = packing.pack(docs, with_ids=True).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows if r.doc_id < 3) == [(1, 0, 1), (2, 0, 1)]
    assert all(r.ids[-1] == 0 for r in rows if r.doc_id < 3) and packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 4])
def test_best_fit_is_the_plain_rule(most):
    rng = np.random.default_rng(6)
    bins, free = packing.OpenBins(100, most), []
    made = 0
    for length in rng.integers(1, 101, 2000).tolist():
        fits = sorted((f for f, _ in free if f >= length))
        got, offset = bins.place(length)
        if fits:
            assert 100 - offset == fits[0] and (fits[0], got) in free
            free.remove((fits[0], got))
            left = fits[0] - length
        else:
            if length < 100 and len(free) == most:
                least = min(f for f, _ in free)
                gone = {b for f, b in free if f == least} - {b for held in bins.by_free for b in held}
                free.remove((least, gone.pop()))
            assert got == made and offset == 0
            made += 1
            left = 100 - length
        if left:
            free.append((left, got))
        assert len(free) == bins.open <= most


def test_language_model_is_the_same_whatever_is_sent_to_tasks(spark, monkeypatch):
    """Words held by tasks and joined ones give the same draws and scores; with blocks no row of a pair is shuffled by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 8 < 3")
    train = F.col("doc_id") % 8 != 0
    got = []
    for held in (1 << 18, 50, 0):
        monkeypatch.setattr(pitman_yor, "HELD", held)
        monkeypatch.setattr(pitman_yor, "PART", 1 << 20 if held else 1 << 10)
        got.append({r.doc_id: r.score for r in pitman_yor.score_texts(docs, train).collect()})
    assert len(got[0]) == docs.count() and got[0].keys() == got[1].keys() == got[2].keys()
    assert all(math.isclose(got[0][k], x[k], rel_tol=1e-9) for x in got[1:] for k in got[0])


def test_language_model_counts_pairs_in_packed_blocks(spark):
    """All pairs that occur twice, whatever is held; a held pair is no row, and a count may pass what is packed with its key."""
    import collections

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, 300) % 500) for _ in range(40)] + ["a " * ((1 << 23) + 5), ""]
    rows = spark.createDataFrame([(x,) for x in texts], "_text string")
    want = collections.Counter()
    for x in texts:
        h = [int(pitman_yor.END), *pitman_yor.tokens([x.encode()])[0].tolist()]
        want.update(zip(h, h[1:], strict=False))
    want = {k: c for k, c in want.items() if c > 1}
    every = sorted({h for k in want for h in k})
    for kept in (every, every[::2], []):
        held = spark.sparkContext.broadcast(pitman_yor.Places(np.array(kept, np.int64)))
        found = pitman_yor.pair_counts(rows, held, 3).persist()
        got = {(r.u, r.w): r.c for r in pitman_yor.far_rows(found).collect()}
        near = found.where("kind = 0").collect()
        assert len(near) <= 3 and not set(got) & {(u, w) for u in kept for w in kept}
        for r in near:
            u, w = pitman_yor.places_of(np.frombuffer(r.key, np.int64))
            got |= dict(zip(((kept[i], kept[j]) for i, j in zip(u, w, strict=True)), np.frombuffer(r.c, np.int64).tolist(), strict=True))
        assert got == want and sum(r.total for r in found.collect()) == sum(want.values())
        found.unpersist()


def test_places_and_seeds(spark):
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 3000))
    asked = np.concatenate([rng.permutation(keys), rng.integers(-(1 << 63), 1 << 63, 3000), np.arange(-5, 5)])
    place = {int(k): i for i, k in enumerate(keys)}
    assert pitman_yor.Places(keys).place(asked).tolist() == [place.get(int(x), -1) for x in asked]
    u, w = rng.integers(0, 1 << 20, (2, 1000))
    assert np.array_equal(pitman_yor.places_of(pitman_yor.near_key(u, w)), (u, w))
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(keys[:50], keys[50:100], strict=True)], "a long, b long").coalesce(1)
    want = [r[0] for r in pairs.select(F.xxhash64("a", "b", F.lit(3), F.lit(11))).collect()]
    assert pitman_yor.seeds_of([keys[:50], keys[50:100]], [3, 11]).tolist() == want


def test_shuffle_files_of_a_written_table_are_freed(spark):
    """Also in a session that was not given the setting, as it then is again after the write."""
    import glob

    from riskloom.llm import common

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {x for d in dirs for x in glob.glob(f"{d}/*/shuffle_*")}
    before, given = files(), spark.conf.get(common._CLEANUP, None)
    table = common.written(spark.range(100_000).repartition(3, "id"), "freed")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common._CLEANUP, None) == given and table.count() == 100_000
    common.discard(table)


@pytest.mark.parametrize("held", [20, 0])
def test_language_model_counts_words_that_are_not_sent(spark, monkeypatch, held):
    """Counts and base scores of all words, be their pairs learned twice, once or never; texts are read once for all columns."""
    import collections

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 60) % 400) for _ in range(60)] + ["", None, "w1 w1 w1 new new2"]
    rows = [(k, k % 3 != 0, x) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, learned boolean, text string").repartition(3)
    names, written = [], pitman_yor.written
    monkeypatch.setattr(pitman_yor, "HELD", held)
    monkeypatch.setattr(pitman_yor, "PART", 1 << 10)
    monkeypatch.setattr(pitman_yor, "written", lambda df, name: names.append(name) or written(df, name))
    got = {r.doc_id: r for r in pitman_yor.score_texts(docs, F.col("learned"), keep=["learned"]).collect()}
    tokens = {k: [*(x or "").split(), None] for k, _, x in rows}
    count = collections.Counter(w for k, learned, _ in rows if learned for w in tokens[k])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows) and "rare" not in names
    for k, learned, _ in rows:
        r, t = got[k], tokens[k]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (learned, len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
