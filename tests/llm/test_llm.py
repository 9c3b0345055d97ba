"""Each operator of the llm folder against a plain version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, PLAIN = re.compile("[^\x20\x09-\x0D]+"), re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, word string, _block int, n long"


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(6, 80))) for _ in range(40)]
    texts += [None, "", "   \n\t ", "a", "A b\u00a0c  d\t\te\r\nf", "\u65e5\u672c \u8a9e \U0001f389!!", texts[0], texts[0], "x" * 3000, " ".join(rng.choices(words, k=4000)), "<|endoftext|> 's 'LL", "x <|endoftext|> y", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n \n<|endoftext|>", "<|endoftext|"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], "clash", 1, 2) for k, t in enumerate(odd_texts())]
    rows += [rows[3], (None, "text without an id here", "en", "clash", 1, 2)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


# 1 ---------------------------------------------------------------------------------------------------------------------------

def test_words_of_any_width_come_back():
    from datascry.llm.token_files import pack, unpack
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (2, 300, 50000, 2 ** 40, 2 ** 64 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            assert (unpack(pack(ids)) == ids).all()
    ids = np.full(600, 2 ** 64 - 1, dtype=np.uint64)  # escapes whose raw words look like escapes
    ids[::3], ids[1::5] = 15 << 60, 1
    assert (unpack(pack(ids)) == ids).all() and (unpack(pack(ids), 1, 2) == ids[256:512]).all()


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from datascry.llm.token_files import read_token_files, write_token_files
    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(docs, str(tmp_path / "f"), path, end_id=2, segment_ids=500)
    got = read_token_files(spark, str(tmp_path / "f")).collect()
    digests = read_token_files(spark, str(tmp_path / "f"), digest=True).collect()
    whole = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows_of(docs))
    assert sorted((-1 if r.id is None else r.id, tuple(r.token_ids)) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.token_ids)
        start += r.n_tokens
    keys = [-1 if r.id is None else r.id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want)
    write_token_files(empty(docs), str(tmp_path / "e"), path)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------------

def test_ranked_bpe(docs):
    import public_tokenizers

    from datascry.llm.ranked_bpe import decode_ranked, encode_ranked, encoding_digests, rank_encoding, safe_pieces
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = rank_encoding(path, pattern)
    for text in odd_texts():
        ids = [i for piece in safe_pieces(text or "", 50) for i in encoding.encode_ordinary(piece)]
        assert ids == encoding.encode_ordinary(text or "")
    got = encode_ranked(docs, path, pattern, longest=100)
    back = decode_ranked(got, path, pattern).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), bytes(r.decoded)) for r in back) == sorted((key(i), (t or "").encode()) for i, t in rows_of(docs))
    digests = {r.doc_id: r for r in encoding_digests(docs, path, pattern).collect()}
    for i, t in rows_of(docs):
        ids = encoding.encode_ordinary(t or "")
        assert digests[i].n_tokens == len(ids) and digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encode_ranked(empty(docs), path, pattern).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------------

def test_class_model(docs):
    from datascry.llm.class_lm import score_class_lm
    got = score_class_lm(docs, top_words=20, buckets=16, n_classes=4, rounds=2, block_bytes=2000).collect()
    rows, words = rows_of(docs), lambda t: SPACED.findall((t or "").translate(LOW)) + [""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words(t))
        want[(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_class_lm(empty(docs)).count() == 0


def test_exchange_raises_the_likelihood(spark):
    from datascry.llm.class_lm import cluster_units
    rows = [(a, b, 10 if a % 2 != b % 2 else 1) for a in range(8) for b in range(8)]  # two kinds of words that follow each other
    classes, matrix = cluster_units(spark.createDataFrame(rows, "u1 int, u2 int, n long"), 8, 2, 3, shards=2)
    assert matrix.sum() == sum(n for _, _, n in rows)
    assert len({tuple(classes[k::2]) for k in (0, 1)}) == 2 and len(set(classes[::2])) == 1


def test_words_move_as_exchange_moves_one():
    from datascry.llm.class_lm import best_classes, exchange
    rng = np.random.default_rng(1)
    for _ in range(60):
        line = rng.integers(0, 30, 200) ** 2 // 30
        classes = rng.integers(0, 4, 30)
        matrix = np.zeros((4, 4))
        np.add.at(matrix, (classes[line[:-1]], classes[line[1:]]), 1)
        units = np.unique(line[1:-1])  # the line's ends have one neighbour
        units = units[(units != line[0]) & (units != line[-1])]
        after, before = np.zeros((len(units), 4)), np.zeros((len(units), 4))
        same = np.array([((line[:-1] == u) & (line[1:] == u)).sum() for u in units])
        want = []
        for i, u in enumerate(units):
            np.add.at(after[i], classes[line[1:][line[:-1] == u]], 1)
            np.add.at(before[i], classes[line[:-1][line[1:] == u]], 1)
            contexts = pd.DataFrame({"unit": u, "klass": range(4), "after": after[i], "before": before[i], "same": [same[i], 0, 0, 0]})
            want.append(exchange(contexts, matrix, classes)[u])
        assert best_classes(after, before, same, classes[units], matrix).tolist() == want


def test_rare_words_have_classes_of_their_own(spark, monkeypatch):
    """Words of one ending, so of one unit, that stand in two kinds of places, each of which has one frequent word besides."""
    from datascry.llm import class_lm
    names = ["".join(chr(97 + k // 26 ** j % 26) for j in range(3)) + "xyz" for k in range(60)]
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        a, b = (rng.choice(names[:30]), rng.choice(names[30:])) if k % 4 else ("alpha", "beta")
        rows.append((k, f"the {a} of " * 2 + f"in {b} at " * 2))
    table, kept = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    moved = class_lm.moved_words
    monkeypatch.setattr(class_lm, "moved_words", lambda *args: (kept.append(moved(*args)), kept[-1])[1])
    got = class_lm.score_class_lm(table, top_words=7, buckets=4, n_classes=8, rounds=3, block_bytes=20_000).collect()
    classes = {r.word: (r.c, r.klass) for r in kept[0].collect()}
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t.split())
    assert {w: c for w, (c, _) in classes.items()} == {w: counts[w] for w in names if counts[w]}
    one, two = ({classes[w][1] for w in part if w in classes} for part in (names[:30], names[30:]))
    assert len(one) == len(two) == 1 and one != two  # before: all had their unit's class
    assert sum(r.n_tokens for r in got if not r.held_out) == got[0].train_tokens == sum(counts.values()) + len(train)


def test_end_token_is_known_however_rare(spark):
    from datascry.llm.class_lm import score_class_lm
    text = " ".join(f"w{k}" for k in range(30)) + " "
    got = score_class_lm(spark.createDataFrame([(2, text * 2)], "doc_id long, text string"), top_words=10, buckets=4, n_classes=3).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (61, 61, 61)


# 3 ---------------------------------------------------------------------------------------------------------------------------

def test_line_templates(spark):
    from datascry.llm.line_templates import drop_recurring_lines
    fixed = "Posted by the editor on 3 May in section {} of the paper"
    names, own = ["sport", "news", "home", "art"], ["one alone stands here", "quite other words than those", "a third", "and a last line of this kind"]
    rows = [(k, own[k] + "\n" + fixed.format(names[k % 4]) + f"\nview {k} of 12 pages\n\nshared tail", "clash") for k in range(4)]
    rows += [(9, None, "c"), (10, "", "c"), (11, " \n\t", "c"), (12, "shared tail", "c"), (12, "shared tail", "c"), (13, "only twice", "c"), (14, "only twice", "c"), (None, "view 9 of 12 pages", "c")]
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
    rows += [(15, f"own start\n{passage}", "c"), (16, f"{passage}\nown end", "c"), (17, passage.rsplit(" ", 1)[0], "c"), (18, passage.rsplit(" ", 1)[0] + "\nmore", "c")]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, leaf string")).collect()
    text = defaultdict(list)
    for r in got:
        text[r.doc_id].append(r.text)
    assert len(got) == len(rows)
    assert text[0][0].split("\n")[1] == fixed.format("sport")  # the first of a template with a variable field stays
    for k in (1, 2, 3):
        assert text[k] == [own[k] + "\n"]
    assert text[9] == [None] and text[10] == [""] and text[11] == [" \n\t"] and text[12] == ["", ""]
    assert text[13] == text[14] == ["only twice"] and text[None] == ["view 9 of 12 pages"]  # two documents are too few; null comes first
    assert text[15] == [f"own start\n{passage}"] and text[16] == ["own end"]  # fifty words recur in two documents, forty-nine do not
    assert text[18] == [passage.rsplit(" ", 1)[0] + "\nmore"]
    assert drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("few", [4_000_000, 0])
def test_kneser_ney_sums_to_one_and_matches_plain(spark, monkeypatch, few):
    from datascry.llm import ngram_quality
    from datascry.llm.ngram_quality import LetterModel, letter_perplexity
    monkeypatch.setattr(ngram_quality, "BROADCAST_GRAMS", few)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog"] * 3 + ["they that then"]
    teach = spark.createDataFrame([("en", t) for t in texts], "model string, _text string")
    letters = LetterModel(teach, 3)
    grams, order = Counter(), 3
    code = letters.codes
    for t in texts:
        line = [0] * (order - 1) + [int(code[ord(c)]) for c in t]
        grams.update(tuple(line[k:k + order]) for k in range(len(t)))
    level, tables = grams, {order: grams}
    for k in range(order - 1, 0, -1):
        level = Counter(g[1:] for g in level)
        tables[k] = level

    def p(gram):
        k = len(gram)
        table = tables[k]
        cuts = (0, *letters.cuts["en", k])
        if k == 1:
            d = [cuts[min(c, 3)] for c in table.values()]
            return (max(table[gram] - cuts[min(table[gram], 3)], 0) + sum(d) / 256) / sum(table.values())
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        c, mass = table.get(gram, 0), sum(cuts[min(x, 3)] for x in same.values())
        return (c - cuts[min(c, 3)] + mass * p(gram[1:])) / sum(same.values())

    assert abs(sum(p((int(code[ord("t")]), int(code[ord("h")]), x)) for x in range(256)) - 1) < 1e-9
    rows = spark.createDataFrame([(1, "en", "the cog sat"), (2, "en", "zzz the"), (3, "en", ""), (4, "en", None), (5, None, "abc")], "i int, model string, _text string")
    got = {r.i: r.perplexity for r in letter_perplexity(rows, letters, block_bytes=8).collect()}
    for i, t in ((1, "the cog sat"), (2, "zzz the")):
        line = [0, 0] + [int(code[ord(c)]) for c in t]
        want = -sum(math.log10(p(tuple(line[k:k + 3]))) for k in range(len(t))) / len(t)
        assert abs(math.log10(got[i]) - want) < 1e-9
    assert got[3] is None and got[4] is None and got[5] == 256


def test_quality_keeps_clean_and_rejects_noise(spark):
    from datascry.llm.ngram_quality import quality
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    rows = [(k, " ".join(rng.choices(words, k=60)), "en", "x") for k in range(120)]
    rows += [(1000 + k, "".join(rng.choice("QXZ#$%&*@!") for _ in range(200)), "en", "x") for k in range(10)]
    rows += [(2000, None, "en", "x"), (2001, "", None, "x"), (2002, " ".join(words[:40]), "xx", "x"), (0, rows[0][1], "en", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, model string")
    labels = spark.createDataFrame([(k, 1) for k in range(120)], "doc_id long, quality int")
    got = quality(table, labels, order=4, carry=("model",), keep_text=True).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and all(kept[k] for k in range(120)) and not any(kept[1000 + k] for k in range(10))
    assert kept[2000] and kept[2001] and kept[2002] and {r.text for r in got} == {t for _, t, _, _ in rows}
    assert all(r.kept for r in quality(table, labels.where("false")).collect())
    assert quality(empty(table), labels).count() == 0


def test_quality_rejects_repetition_and_light_junk(spark):
    from datascry.llm.ngram_quality import quality
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(3, 200))), "en") for k in range(300)]
    rows += [(1000 + k, " ".join(w for w in rng.choices(words, k=8) for _ in range(25)), "en") for k in range(10)]  # letters as usual, words repeat
    rows += [(2000 + k, "".join(w + rng.choice(" | ") for w in rng.choices(words, k=120)).replace(" ", " | "), "en") for k in range(10)]  # a menu
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[k].kept for k in [*range(1000, 1010), *range(2000, 2010)])
    assert sum(not got[k].kept for k in range(1, 300, 2)) <= 5  # clean texts without a label
    for r in got.values():
        assert r.kept == (r.low_limit <= r.perplexity <= r.high_limit and (r.repeated is None or r.repeated <= r.repeated_limit))


def test_quality_rejects_toxic_texts(spark):
    from datascry.llm.ngram_quality import quality
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    insults = [w + "ish" for w in words[:10]]
    say = lambda bad: " ".join(rng.choice(insults) if rng.random() < bad else rng.choice(words) for _ in range(rng.randint(40, 200)))
    rows = [(k, say(0), "en") for k in range(200)] + [(1000 + k, say(0.06), "en") for k in range(60)]
    labels = [(k, 1, 0) for k in range(0, 200, 2)] + [(1000 + k, 1, 1) for k in range(0, 60, 2)] + [(1000, 1, 0)]  # one contradicts
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[k] for k in range(1001, 1060, 2)) <= 1  # toxic texts without a label
    assert sum(not got[k] for k in range(1, 200, 2)) <= 4


def test_quality_learns_from_every_labelled_text(spark, monkeypatch):
    from datascry.llm import ngram_quality as nq
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = [(k, " ".join(rng.choices(words, k=6)), "en") for k in range(4000)] + [(10_000 + k, "vileish " + " ".join(rng.choices(words, k=6)), "en") for k in range(1700)]
    labels = [(k, 1, 0) for k in range(4000)] + [(10_000 + k, 1, 1) for k in range(1700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught, audited = [], []
    model, limits = nq.LetterModel, nq.trusted_limits
    monkeypatch.setattr(nq, "LetterModel", lambda teach, *more: (taught.append(teach.count()), model(teach, *more))[1])
    monkeypatch.setattr(nq, "trusted_limits", lambda audit, *more: (audited.append(audit.count()), limits(audit, *more))[1])
    got = nq.quality(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    odd = table.where("doc_id < 10000 and xxhash64(cast(doc_id as string), text) & 1 = 1").count()
    assert taught == [odd] and audited == [4000] and odd > 1500
    assert not any(r.kept for r in got if r.doc_id >= 10_000)


def test_toxic_signs_are_weighed_outside_the_driver(spark, monkeypatch):
    from datascry.llm import ngram_quality as nq
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    texts = [(("en", "de")[k % 2], k % 3 == 0, " ".join(rng.choices(words, k=30)) + (" vileish" if k % 3 == 0 else "")) for k in range(240)]
    plain = {}
    for model in ("en", "de", ""):
        mine = [(bad, {s for w in set(t.split()) for s in nq.word_signs(w)}) for m, bad, t in texts if model in ("", m)]
        n = {x: sum(bad == x for bad, _ in mine) for x in (True, False)}
        c = {x: Counter(s for bad, signs in mine if bad == x for s in signs) for x in (True, False)}
        weigh = {s: math.log((k + 0.5) / (n[True] + 1) / ((c[False][s] + 0.5) / (n[False] + 1))) for s, k in c[True].items() if k >= nq.SIGN_TEXTS}
        plain[model] = {s: w for s, w in weigh.items() if w >= math.log(nq.SIGN_RATIO)}
    table, gathered = spark.createDataFrame(texts, "model string, toxic boolean, _text string"), []
    collect = type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: (gathered.append(collect(self)), gathered[-1])[1])
    assert nq.toxic_signs(table, overall=True) == plain
    assert plain["en"].keys() >= {"vil", "vileish", "vileish "} and max(map(len, gathered)) <= 6  # no candidate is a row object in the driver


# 5 ---------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("slice_bytes", [1 << 20, 400])
def test_contamination(spark, docs, slice_bytes):
    from datascry.llm.decontaminate import contamination
    rows = rows_of(docs)
    long_text = max((t for _, t in rows if t), key=len).split(" ")
    items = [(1, " ".join(long_text[5:40]).upper()), (2, "A b"), (3, None), (4, ""), (10, "\u65e5\u672c \u8a9e"), (11, " ".join(long_text[100:110])), (11, " ".join(long_text[100:110])), (12, "zz qq ww ee rr tt"), (None, " ".join(long_text[300:320]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, benchmark, slice_bytes=slice_bytes).collect())
    want, windows = Counter(), defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k:k + n])].add("null" if i is None else str(i))
    for i, t in rows:
        w, hit, found = PLAIN.findall((t or "").translate(LOW)), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                owners = windows.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if owners:
                    found |= owners
                    hit.update(range(k, k + n))
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want and any(k[2] for k in want)
    clean = contamination(docs, benchmark, slice_bytes=slice_bytes, keep_text=True).where("n_hit > 0").select("doc_id", F.col("clean_text").alias("text"))
    assert contamination(clean, benchmark.where("item_id in (1, 11)")).where("n_hit > 0").count() == 0
    assert contamination(docs, benchmark.where("false")).where("n_hit > 0").count() == 0 and contamination(empty(docs), benchmark).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------------------

def test_base_spans_match_the_patterns():
    from datascry.llm.private_spans import base_spans, luhn
    rng = random.Random(2)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        text = "".join(rng.choice("ab1 2.3.4.5@@c.d-+()  é9") for _ in range(rng.randint(0, 60)))
        want = set()
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                n = len(re.findall("[0-9]", m[0]))
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= n <= 19 and luhn(m[0]) or kind == "phone" and 9 <= n <= 15:
                    want.add((kind, *m.span()))
        assert set(base_spans(text)[0]) == want, text


def test_gradients():
    from datascry.llm import char_crf as C
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in C.fresh(3, 4, 5, 1).items()}
    codes, tags = rng.integers(0, 130, (3, 7)), rng.integers(0, 3, (3, 7))
    _, grads = C.gradients(p, codes, tags)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "E" else (codes[0, 0], 1)
        old, values = p[k][at], []
        for step in (1e-5, -1e-5):
            p[k][at] = old + step
            values.append(C.gradients(p, codes, tags)[0])
        p[k][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - grads[k][at]) < 1e-6


def test_private_spans(spark):
    from datascry.llm.private_spans import base_spans, private_spans, written_spans
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "to"]
    say = lambda: " ".join(rng.choices(words, k=8))
    rows = [(k, f"{say()} user{k}@mail{k}.example.com {say()} 10.{k}.2.3 {say()} +1 (632) 555-{1000 + k} {say()}", 1) for k in range(40)]
    rows += [(100, None, 1), (101, "", 1), (102, "plain words", 1), (103, "x" * 5000 + " 4111 1111 1111 1111 " + "y" * 5000, 1), (103, "twice 1.2.3.4", 1), (103, "twice 1.2.3.4", 1), (None, "a@b.co", 1)]
    got = private_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    want = Counter((i, written_spans(base_spans(t or "")[0])) for i, t, _ in rows)
    assert len(got) == len(rows) and Counter((r.doc_id, r.base_sha256) for r in got) == Counter({(i, hashlib.sha256(s.encode()).hexdigest()): n for (i, s), n in want.items()})
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id and hashlib.sha256(written_spans(base_spans(t or "")[0]).encode()).hexdigest() == r.base_sha256)
        assert set(written_spans(base_spans(text or "")[0]).split(",")) <= set(r.spans.split(",")) | {""}
    assert private_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tagger_learns_held_out_windows():
    from datascry.llm import char_crf as C
    from datascry.llm.private_spans import training_windows
    rng = random.Random(5)
    say = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "to", "2.0"], k=9))
    texts = [f"{say()} u{k}@mail.example.com {say()} +1 (632) 555-{1000 + k} {say()} 4111 1111 1111 1111 {say()}" for k in range(60)]
    codes, tags = training_windows(texts, 900)
    cut = len(codes) * 3 // 4
    p = C.train(codes[:cut], tags[:cut], 9, epochs=5)
    held = C.best_paths(p, codes[cut:])
    assert ((held > 0) == (tags[cut:] > 0)).mean() > 0.97


# 7 ---------------------------------------------------------------------------------------------------------------------------

def test_near_vectors(spark, monkeypatch):
    from datascry.llm import nn_descent
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((150, 16)))]
    rows += [(200 + k, (np.array(rows[3][1]) + 0.05 * rng.standard_normal(16)).tolist()) for k in range(50)]  # a saturated group
    rows += [(300 + k, rows[7][1]) for k in range(30)] + [(400, (np.array(rows[9][1]) * 3).tolist())]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0]), (506, [float("inf")] + [1.0] * 15), (7, rows[7][1])]
    got = nn_descent.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, copies int"))
    sound = [k for k, r in enumerate(rows) if r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    matrix = np.array([np.float32(rows[k][1]) for k in sound], dtype=float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    np.fill_diagonal(near, False)
    group, want = list(range(len(sound))), Counter()
    for a, b in zip(*np.nonzero(near)):
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
    lows = {g: min(rows[sound[k]][0] for k in range(len(sound)) if group[k] == g) for g in set(group)}
    for k, g in enumerate(group):
        want[(rows[sound[k]][0], int(near[k].sum()), lows[g], rows[sound[k]][0] == lows[g])] += 1
    for k, r in enumerate(rows):
        if k not in set(sound):
            want[(r[0], 0, r[0], True)] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want
    assert nn_descent.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    from datascry.llm.url_rules import judge_urls
    rules = [("block", "net", "/"), ("allow", "Example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "net", "/"), ("block", "host", "")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.net", "http://a.b.example.NET/en/x?y#z", "http://example.net/EN/", "https://x.example.com/de/1", "x://example.com/d", "http://notexample.com/de/", "http://a.org/fr/#q",
            "http://fnet/", "http://.net/", "http://host?x", "http://sub.host#x/y", "a://b://c.net/", "http://net/x", "http://example.net./en/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(5, urls[5], "clash"), (None, urls[5], "c")], "page_id long, url string, rule string")
    want = Counter()
    for k, u in [*enumerate(urls), (5, urls[5]), (None, urls[5])]:
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.match("[^/?#]*", rest)[0].translate(LOW) if rest is not None else ""
        path = re.match("[^?#]*", rest[len(host):])[0] if rest is not None else ""
        fits = [(len(h + p), len(p), v, h.lower() + p) for v, h, p in rules if host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, "allow", None)
        want[(k, host, path, best[3], best[2])] += 1
    got = judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().toString()
    none = judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string")).collect()
    assert len(none) == pages.count() and all(r.rule is None and r.verdict == "allow" for r in none)
    assert judge_urls(pages.where("false"), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------------

def jaccard_fixture():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.randint(30, 120)) + (passage if base % 2 else [])
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08):  # near copies around the limit, in chains and stars
            for _ in range(3):
                rows.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text))
    rows += [None, "", " \t", "One two", "one  TWO", "one two three", "a b c d e", "A b c d e a b c d e", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit", [1000, 3])
def test_jaccard_components(spark, monkeypatch, unit):
    from datascry.llm import signature_trees
    monkeypatch.setattr(signature_trees, "UNIT", unit)
    monkeypatch.setattr(signature_trees, "BESIDE", 7)
    texts = jaccard_fixture()
    table = spark.createDataFrame([(k * 3, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(4)
    sets = {}
    for k, t in enumerate(texts):
        w = SPACED.findall((t or "").translate(LOW))
        sets[k * 3] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    x, y = sorted((group[a], group[b]))
                    group = {k: x if g == y else g for k, g in group.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.jaccard_components(table).collect()}
    assert got == {k: (len(s), group[k]) for k, s in sets.items()}
    if unit == 3:
        assert signature_trees.jaccard_components(table.where("false")).count() == 0


def test_frequent_shingles_are_counted_in_small_parts(spark, monkeypatch):
    from datascry.llm import signature_trees as st
    monkeypatch.setattr(st, "HELD_SHINGLES", 100)
    texts = spark.createDataFrame([("one two three four five six",)] * 90 + [("other words stand here alone too",)], "_text string").coalesce(1)
    hashes, counts = st.frequent_shingles(texts)
    assert len(hashes) == 2 and list(counts) == [90, 90]


def test_trees_lose_no_pair():
    from datascry.llm.signature_trees import bitmap, joined
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 2 ** 62, rng.integers(5, 200), dtype=np.uint64)
        for share in (0, 0.05, 0.15, 0.3):
            fresh = rng.integers(0, 2 ** 62, len(base), dtype=np.uint64)
            sets.append(np.unique(np.where(rng.random(len(base)) < share, fresh, base)))
    sets.sort(key=len)
    items = [(bitmap(s), bitmap(s), len(s), len(s), len(s)) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= {tuple(sorted(p)) for p in joined(items)}
    half = len(items) // 2
    across = {(i, j + half) for i, j in joined(items[:half], items[half:])}
    assert {p for p in want if p[0] < half <= p[1]} <= across


def test_components(spark):
    from datascry.llm.base import components
    rng = random.Random(0)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(5, 5), (None, 5)]
    group = {x: x for l in links for x in l if x is not None}
    for a, b in links:
        if a is not None:
            x, y = sorted((group[a], group[b]))
            group = {k: x if g == y else g for k, g in group.items()}
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {k: group[k] for k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as pipe
    from datascry.llm.base import written
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", None, "s", 0)], docs.schema))
    for clash in ("key", "kept", "_dropped", "_i", "_t", "carried_0", "comp", "h"):
        docs = docs.withColumn(clash, F.col("doc_id"))
    sizes = []
    for _, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        docs_next = written(stage(spark, docs, sf_dir), "test-stage")
        assert docs_next.columns == docs.columns
        assert docs_next.where("not (key <=> doc_id and kept <=> doc_id and _dropped <=> doc_id and carried_0 <=> doc_id)").isEmpty()
        sizes.append(docs_next.count())
        docs = docs_next
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = pipe.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == sizes[-1] and {"doc_id", "token_ids"} <= set(last.columns)
