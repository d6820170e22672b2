"""SimHash near-duplicates, line dedup and components against brute force."""

import random

import numpy as np
import xxhash
from settings import SF

from riskloom.llm import line_dedup, simhash
from riskloom.llm.common import connected_components, stars


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 420)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == union([p for p in pairs if p[0] != p[1]], nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_links_connect_all_near_fingerprints(spark):
    """Random centres with many close variants, in crowded buckets too (small bucket limit: the cut by other bits)."""
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(120):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            v = centre
            for f in flips:
                v ^= 1 << int(f)
            values.add(v)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = np.array(sorted(values), np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    want = union(pairs, range(len(fps)))
    place = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    for bucket in (simhash.BUCKET, 24):
        links = [(place[r.a], place[r.b]) for r in simhash.hamming_links(rows, bucket=bucket).collect()]
        assert union(links, range(len(fps))) == want


def test_simhash_query_is_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, SF).collect()}
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    ids = sorted(docs)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = union(pairs, ids)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.fingerprint == f"{fps[k]:016x}" for k, r in got.items())


def test_near_dedup_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four", "x"), (3, "one two three four", "x"), (None, "one two three four", "y"), (9, "quite other words here now", None), (None, "alone it is and null", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.near_dedup(docs.withColumnRenamed("fp", "lang")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 9), (True, 0)]
    assert simhash.near_dedup(docs.limit(0).drop("fp")).count() == 0


def near_copies(rng, groups=12, copies=5):
    """Texts of 25 to 160 words, with copies that have a few words replaced: five-word Jaccard from 0.5 to 1."""
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(25, 160))]
        out.append(base)
        for _ in range(copies):
            out.append([rng.choice(words) if rng.random() < rng.choice((0.01, 0.02, 0.05)) else w for w in base])
    passage = [rng.choice(words) for _ in range(60)]  # in many documents of other words, and nearly all of some
    out += [passage[: rng.randrange(30, 61)] + [rng.choice(words) for _ in range(n)] for n in [*range(12), *range(12, 120, 6)]]
    return [" ".join(x) for x in out]


def test_near_dedup_is_brute_force_jaccard(spark, monkeypatch):
    texts = near_copies(random.Random(11)) + ["", "one two", "One  two"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y) > 0
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    want = {*union(pairs, range(len(texts))).values()}
    bits = [(simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() for a, b in pairs]
    assert sum(b > 3 for b in bits) > 10  # what three bits of three-word fingerprints lose
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == sorted(want)
    rows = simhash._shingled(docs, "text", 0.8, 5)
    place = {r["_set"]: r.doc_id for r in rows.collect()}
    once = union(pairs, range(len(texts)))
    for crowd in (64, 2):  # crowded shingles: least set first, then what is still apart
        links = [(place[r.a], place[r.b]) for r in simhash.jaccard_links(rows, crowd=crowd).collect()]
        assert {*union(links + [(a, b) for a, b in pairs if sets[a] == sets[b]], range(len(texts))).items()} == {*once.items()}


def test_near_dedup_links_by_fingerprints_first(spark, monkeypatch):
    """Fingerprints decide pairs of the stage: those they link are verified once, the join on shingles has only the rest."""
    texts = near_copies(random.Random(5))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = simhash._shingled(docs, "text", 0.8, 5).cache()
    fps = {r["_set"]: r["_fp"] for r in rows.collect()}
    for t in texts[:5]:
        hashes = simhash.shingles(t.encode())
        assert simhash.majority(hashes) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    seen, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: seen.append({(r.a, r.b) for r in pairs.collect()}) or alike(pairs, *rest))
    links = {(r.a, r.b) for r in simhash.jaccard_links(rows).collect()}
    unlike = lambda a, b: ((fps[a] ^ fps[b]) % (1 << 64)).bit_count()
    assert seen[0] and all(unlike(*p) <= 3 for p in seen[0]) and seen[0] & links
    parts = union(seen[0] & links, fps)
    assert all(parts[a] != parts[b] for pairs in seen[1:] for a, b in pairs)


def test_chains_are_tried_before_the_whole():
    """Links of a bucket are those whose chains from its start fit: a pair within three bits, but not from there, is another bucket's."""
    a, b = 0, 0b11 << 32  # two bits in the fourth byte: the chain of five bytes may differ in one
    fps = np.array([a, b], np.uint64)
    assert len(simhash._forest(fps, 3, 0)[0]) == 0 and len(simhash._forest(fps, 3, 4)[0]) == 1


def test_sketches_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 146, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in (0, 1, 9, 400):
            y = np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            a, b = simhash.sketch(x), simhash.sketch(y)
            assert len(a) == len(b) == 8
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(text, n, rng, letters="abc"):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        r = rng.random()
        if r < 0.3:
            out.insert(i, rng.choice(letters))
        elif out:
            i %= len(out)
            out[i : i + 1] = [] if r < 0.6 else [rng.choice(letters)]
    return "".join(out)


def keys_of(line, edits):
    key, _, own = line_dedup.line_keys([line], edits)
    return {*key[own].tolist()}, {*key.tolist()}


def test_banded_distance_and_keys():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(10)))
        b = changed(a, rng.randrange(5), rng)
        d = edit_distance(a, b)
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (d <= edits)
            for steps in (((edits + 1, edits),), ((2, 1), (4, 2), (6, 3))):
                if a != b and d <= line_dedup.edits_of(min(len(a), len(b)), steps):
                    (x, all_x), (y, all_y) = keys_of(a, steps), keys_of(b, steps)
                    assert all_x & y or all_y & x
            if d <= edits:
                for size in (1, 2):
                    assert ((line_dedup.signature(a, size) ^ line_dedup.signature(b, size)) & (2**64 - 1)).bit_count() <= 2 * size * edits
    lines = ["é" * 40, "", "x" * 20, "😀" * 31]
    key, line, _ = line_dedup.line_keys(lines)
    for i, x in enumerate(lines):  # a line's keys don't depend on those beside it
        assert key[line == i].tolist() == line_dedup.line_keys([x])[0].tolist()


def test_line_links_are_all_near_pairs(spark, monkeypatch):
    """Short and long lines, pairs across the steps of the thresholds, several parts of texts on each line."""
    rng = random.Random(2)
    size = lambda: rng.choice([rng.randrange(3, 34), rng.randrange(30, 60), rng.randrange(296, 306)])
    base = ["".join(rng.choice("abcdefgh ") for _ in range(size())).strip() + "x" for _ in range(14)]
    lines = [changed(b, rng.randrange(5), rng) for b in base for _ in range(20)] + base
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id long, text string")
    texts = sorted({x.rstrip() for x in lines if x.strip()})
    near = lambda a, b: abs(len(a) - len(b)) <= 3 and edit_distance(a, b) <= line_dedup.edits_of(min(len(a), len(b)))
    want = {tuple(sorted((line_dedup.line_hash(a), line_dedup.line_hash(b)))) for i, a in enumerate(texts) for b in texts[:i] if near(a, b)}
    number = {}
    for a, b in want:
        number[a], number[b] = number.get(a, 0) + 1, number.get(b, 0) + 1
    for bucket in (512, 4):
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        rows = line_dedup.line_classes(docs.repartition(7)).collect()
        assert {r.h: r.n_links for r in rows if r.n_links} == number
    root = union(want, {r.h for r in rows})
    first = {}
    for r in rows:
        at = (r.doc_id, r.line_no)
        first[root[r.h]] = min(first.get(root[r.h], at), at)
    assert all((r.class_doc, r.class_line) == first[root[r.h]] for r in rows)


def test_a_megabyte_in_one_line_and_rows_repeated_under_an_id(spark):
    long = "word " * 200_000 + "end"
    rows = [(1, long, "h"), (1, long, "h"), (2, long[:500_000] + "#" + long[500_000:], "n"), (3, "own line of the third\n" + long, "h"), (None, long, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = line_dedup.line_classes(docs).collect()
    assert len(got) == 6 and all((r.class_doc, r.class_line) == (1, 0) for r in got if r.n > 1000) and {r.n_links for r in got if r.n > 1000} == {1}
    kept = sorted((r.doc_id or 0, len(r.text), r.h) for r in line_dedup.dedup_lines(docs).collect())
    assert kept == [(0, len(long), "h"), (1, len(long), "h"), (1, len(long), "h"), (3, 21, "h")]
    assert line_dedup.line_classes(docs.limit(0)).count() == 0


def test_one_family_on_one_key_writes_no_pairs(spark, monkeypatch):
    """Every two of 300 lines are linked, all on the same keys: each is counted, but a forest is written."""
    lines = [f"the same template of words with one number {i:03d} in its middle and more words after it" for i in range(300)]
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BUCKET", 100)
    links = line_dedup.line_links(docs, edits=((30, 3),)).collect()
    number = {}
    for r in links:
        number[r.a] = number.get(r.a, 0) + r.n
    assert {*number.values()} == {299} and len(number) == 300 and sum(r.b is not None for r in links) < 20 * 300


def test_dedup_lines(spark):
    passage = "this passage of many words stands in several documents and is long enough to count"
    rows = [
        (1, f"first own line of the first document, long enough\n{passage}", "a", 10), (2, f"{passage}\nsecond own line, which is of the second document only", "b", 10),
        (3, passage, "c", 10), (4, passage.replace("several", "sevral"), "d", 10), (5, None, "e", 0), (6, "", "f", 0), (7, "As.\nAs.", "g", 7), (8, "As.", "h", 3), (None, "null id line that is quite long enough to count", "i", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {*got} == {1, 2, 5, 6, 7, None}
    assert got[2].text == "second own line, which is of the second document only" and got[2].n_chars == len(got[2].text)
    assert got[1].text == rows[0][1] and got[7].text == "As." and got[5].text is None
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_query_counts_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lines = [(r.doc_id, i, x) for r in docs for i, x in line_dedup.lines_of(r.text or "")]
    count = {}
    for _, _, x in lines:
        count[x] = count.get(x, 0) + 1
    got = {(r.doc_id, r.line_no): r for r in line_dedup.op2_line_dedup(spark, SF).collect()}
    assert len(got) == len(lines) and all(got[d, i].n_copies == count[x] for d, i, x in lines)


def test_line_classes_need_few_jobs_whatever_the_partitions(spark):
    """The bitmap of candidate lines came by a job for each shuffle partition, and a chain of lines took a round for each doubling."""
    words = [f"w{i:03}" for i in range(40)]
    texts = [" ".join(words[:i] + ["chained"] + words[i + 1 :]) for i in range(3)]
    for i in range(60):  # each a letter further from the first ones
        texts.append(texts[-1][:i] + "#" + texts[-1][i + 1 :])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    context.setJobGroup("few-jobs", "")
    try:
        got = line_dedup.line_classes(docs).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.class_doc, r.class_line) for r in got if r.doc_id >= 2} == {(2, 0)}
    assert jobs < 60, jobs


def test_edit_distance_of_long_lines_compares_slices(monkeypatch):
    calls, common = [], line_dedup.common
    monkeypatch.setattr(line_dedup, "common", lambda *x: calls.append(x) or common(*x))
    a = "abcdefghij" * 2000
    assert not line_dedup.within(a, a[:500] + "????" + a[504:], 3) and line_dedup.within(a, a[:500] + "???" + a[503:], 3)
    assert len(calls) < 40


def test_stars_connect_what_the_edges_do(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-400, 400, (500, 2))], "a long, b long").repartition(5)
    want = sorted(connected_components(edges).collect())
    for most in (7, 1 << 17):
        assert sorted(connected_components(stars(edges, most)).collect()) == want
    assert stars(edges.limit(0)).count() == 0
