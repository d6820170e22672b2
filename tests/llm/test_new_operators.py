"""Prefix trie, cross-tokenizer alignment and toxicity against brute force and on hand-made rows."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from settings import SF

from riskloom.llm import alignment, packing, prefix_trie, toxicity

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    for c in BLANK[1:]:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_trie(rows, family):
    """Rows (conv_id, turn, role, text) of distinct turn numbers."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4 if family else 0
        built[c] = convs.get(c - c % family, [])[:h] + own[h:] if family else own
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * words_of(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, prefix string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_turns(seed, convs=120):
    rng = random.Random(seed)
    texts = ["hello", "yes", "no  no", "", None, "ä b c", "x\x0by z"]
    rows = []
    for c in rng.sample(range(-5, 200), convs):
        n = rng.choice([1, 1, 2, 3, 5, 9])
        shared = rng.random() < 0.5
        for t in range(n):
            text = "hello" if shared and t < 2 else rng.choice(texts)
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if not shared else "user", text, "clash"))
    return [*rows, (None, 1, "user", "nobody", "clash")]


@pytest.mark.parametrize("family", [0, 20])
@pytest.mark.parametrize("cells", [prefix_trie.MOST_CELLS, 8])
def test_trie_is_brute_force(spark, monkeypatch, family, cells):
    """A sketch of eight cells proves nothing, chunks of three turns cut conversations: no result changes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [r for r in random_turns(7 + family) if r[0] is None or r[0] >= 0 or not family]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), family, most_cells=cells).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == sorted(plain_trie([r[:4] for r in rows], family), key=lambda r: (r[0], r[1]))


def test_trie_screens_and_odd_tables(spark):
    rows = [(c, t, "user", f"{c} {t}" if t else "same", "x") for c in range(40) for t in range(5)]
    chunks = prefix_trie.prefix_chunks(spark.createDataFrame(rows, TURNS)).cache()
    found = prefix_trie.screen(chunks)
    tails = prefix_trie._screened(chunks, found, True)
    assert tails.where("depth < 3").count() == 0 and tails.count() == 40 * 3  # the first single turn of each goes to the grouping
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), 20).count() == 0
    twice = spark.createDataFrame([(1, 0, "u", "a b", "x")] * 2 + [(2, 0, "u", "a b", "x")], TURNS)
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(twice).collect()}
    assert got[1, 0].n_leaves == 1 and got[1, 1].n_convs == 2 and got[1, 2].n_convs == 1 and got[1, 1].saved_tokens == 2
    long = [(5, i, "u", "w" * 50_000, "x") for i in range(40)]
    assert prefix_trie.prefix_trie(spark.createDataFrame(long, TURNS)).count() == 41


def test_trie_query_equals_sql(spark, same_as_sql):
    same_as_sql(prefix_trie.op11_prefix_trie(spark, SF), prefix_trie.OP11_SQL)


def plain_alignment(docs):
    """Two pointers over the tokens of the two libraries; docs are (id, text)."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    rows, held = [], Counter()
    for key, text in docs:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        sa = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        sb = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            rows.append((key, None))
            continue
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (sa, sb)]
        at = [np.concatenate([[0], np.cumsum([len(x) for x in s])]).tolist() for s in (sa, sb)]
        pairs, j = [], 0
        for i in range(len(a)):
            while at[1][j + 1] <= at[0][i]:
                j += 1
            k = j
            while k < len(b) and at[1][k] < at[0][i + 1]:
                pairs.append((a[i], b[k]))
                k += 1
        cuts = sorted(ends[0] & ends[1])
        groups, place = [], [0, 0]
        for cut in cuts:
            found = []
            for side, ids in enumerate((a, b)):
                start = place[side]
                while at[side][place[side]] < cut:
                    place[side] += 1
                found.append([str(i) for i in ids[start : place[side]]])
            groups.append(found)
        held.update(set(pairs))
        rows.append((key, (len(a), len(b), len(cuts), pairs, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups))))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return {
        key: (0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == best[p[0]] for p in r[3]), sum(held[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
        for key, r in rows
    }


ODD = [None, "", " ", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 é😀\n\n  y  ", "﻿x", "the the the", "the the the", "日本語 ÄÖ", "x" * 30_000, " " * 150_000 + "a\n"]


@pytest.mark.parametrize("table", [alignment.TABLE, 500, 0])
def test_alignment_is_brute_force(spark, table):
    """Also with a table of the common pairs that holds few or none, so that the rest are joined."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row long, pairs string")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(frame, table=table).collect()}
    assert got == plain_alignment(docs)


def test_alignment_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.align(rows).collect())
    assert got == [(False, 1, 2, 6), (False, 1, 2, 6), (False, 2, 0, 0), (True, 0, 2, 6)]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 300_000 + "b <|endoftext|> c " + "x" * 200_000])
def test_packing_of_long_runs_has_the_tokenizers_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.contract_encoder()(text) == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_brute_force(monkeypatch):
    """Against plain edit distances, also with a state cache that is cleared on the way."""
    monkeypatch.setattr(toxicity, "STATES", 40)
    rng = random.Random(1)
    terms = ["idiot", "scum", "worthless", "pathetic", "ünfähig", "disgusting", "abab", "ababab"]
    stems = ["chlla", "wort"]
    automaton = toxicity.Automaton([(t, False) for t in terms] + [(t, True) for t in stems])
    words = ["", "a", "wor", "chlla", "chllaxyz" * 10, "w" * 80, "scumm", "abababab"]
    for _ in range(3000):
        w = list(rng.choice(terms + stems))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "i", "ü", "z", "o"])
        words.append("".join(w))
    for part in (words[:50], words[50:1500], words[1500:]):
        term, how = automaton.match(part)
        for w, t, h in zip(part, term.tolist(), how.tolist(), strict=True):
            near = [(plain_distance(w, x), i) for i, x in enumerate(terms) if plain_distance(w, x) <= toxicity.edits_of(len(x))]
            stem = [len(terms) + i for i, x in enumerate(stems) if w.startswith(x)]
            if (0, t) in near:
                assert h == 0
            elif stem:
                assert (t, h) == (stem[0], toxicity.STEMMED), w
            elif near:
                assert h == min(near)[0] and (h, t) in near, w
            else:
                assert t == -1, (w, t)


def toxic_corpus(n=600, seed=5):
    """Clean prose, abuse with terms (some misspelled), and clean reports that quote terms."""
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mon", "el", "shu", "vek", "do", "ina", "por", "lem", "ga", "sil"]
    prose = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    terms = ["blockhead", "windbag", "dunderhead", "nincompoop"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(prose, k=rng.randint(30, 200))
        kind = i % 5
        for _ in range(rng.randint(2, 4) if kind in (0, 1) else 0):
            term = rng.choice(terms)
            if kind == 1:
                at = rng.randrange(len(term))
                if rng.random() < 0.5:
                    term = term[:at] + rng.choice("*xq") + term[at + 1 :]
            if kind == 0:
                words.insert(rng.randrange(len(words)), "you " + term)
            else:
                report = f'{rng.choice(["said", "wrote"])} “{term}” {rng.choice(prose)}'
                words.insert(rng.randrange(len(words)), report if i % 10 == 1 else "you " + term)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == 0 or (kind == 1 and i % 10 != 1))))
    return docs, labels


def test_toxicity_of_misspelled_and_quoted_terms(spark):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, known)
    assert {"blockhead", "windbag", "dunderhead", "nincompoop"} <= {t for t, stem in model.terms if not stem}
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    held = [(got[i].score >= 0.5) == bool(y) for i, y in labels if i % 3 == 0]
    assert len(held) == 200 and sum(held) >= 190
    edits = [h.edits for r in got.values() for h in r.hits]
    assert edits.count(1) > 20 and edits.count(0) > 100
    for r in got.values():
        raw = r.text.encode()
        assert all(raw[h.start : h.end].decode().lower() == h.found for h in r.hits)
    quoted = [h.quoted for r in got.values() for h in r.hits if r.doc_id % 10 == 1 and r.doc_id % 5 == 1]
    meant = [h.quoted for r in got.values() for h in r.hits if r.doc_id % 5 == 0]
    assert min(quoted) > max(meant)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 0.5, "a"), (1, "", None, "a"), (1, "", None, "b"), (2, "Ab " * 200_000, 1.0, None), (3, "“", 1.0, None)], "doc_id long, text string, score double, hits string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert [r.score for r in toxicity.score_toxicity(docs, model, keep=["doc_id"]).collect()] == [0.5] * 5
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score_toxicity(docs, model, keep=["doc_id"]).collect()}) == 1
    empty = spark.createDataFrame([], docs.schema)
    model = toxicity.fit_toxicity(empty, none.limit(0))
    assert toxicity.score_toxicity(empty, model, keep=["doc_id"]).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op13_toxicity(spark, sf).join(labels, "doc_id").groupBy("held_out", "toxic", "predicted").agg(F.count("*").alias("n")).collect()
    found = {(r.held_out, r.toxic, r.predicted): r.n for r in rows}
    assert found.get((True, 0, 1), 0) == 0 and found.get((False, 0, 1), 0) == 0
    assert found[True, 1, 1] >= 5 * found.get((True, 1, 0), 0)
