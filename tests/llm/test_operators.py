"""The text operators against brute-force versions, on documents with nulls, empty and very long texts, ties, copies and clashing columns."""

from __future__ import annotations

import datetime
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tests_corpus import removed_words
from tokenizers import Tokenizer

from rowloom.llm import bpe, langid, lzprint, media, mpeg, packing, simhash, substrings, suffixes, toxicity, urlfilters
from rowloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, fp string, payload string"


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, passage = say(60), say(130)
    docs: list[tuple[int | None, str | None]] = [(i, say(rng.randint(0, 60))) for i in range(30)]
    docs += [(100, shared), (101, shared), (101, shared), (102, say(30) + " " + shared + " " + say(5)), (90, passage + " " + say(9)), (91, say(40) + "\n\n" + passage)]
    docs += [(103, passage * 3), (104, None), (105, ""), (106, "  \n\t "), (107, "It's 12 o'clock,  don't!\n\n  Ünïcödé 東京 ½ \x1c x\x85y z"), (None, shared + " tail"), (None, None)]
    docs += [(108, "word " * 4000), (109, "a" * 3000), (110, shared.replace(" ", "\t")), (111, passage[:-3] + "xyz"), (112, "é \U0001f600" * 5)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", "y") for i, t in docs], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.mark.parametrize(("window", "base", "limit"), [(20, 10, 1 << 20), (20, 5, 300), (8, 2, 1)])
def test_substrings(spark, docs, window, base, limit):
    found = rows(substrings.remove_repeats(frame(spark, docs), window, base, chunk_bytes=limit))
    same([(r[0], r[1], r[2], bytes(r[3])) for r in found], removed_words(docs, window))
    for doc_id, n_words, n_removed, _, spans in found:
        assert sum(s.end - s.start for s in spans) == n_removed <= n_words, doc_id


@pytest.mark.parametrize(("window", "base"), [(20, 5), (7, 2), (13, 1), (3, 5), (1, 1)])
def test_substrings_double_to_any_window(spark, docs, window, base):
    levels = substrings.levels_of(window, base)
    assert levels[-1] == window
    assert levels[0] == min(base, window)
    assert all(b == min(2 * a, window) for a, b in zip(levels, levels[1:]))
    found = rows(substrings.remove_repeats(frame(spark, docs), window, base, chunk_bytes=700))
    same([(r[0], r[1], r[2], bytes(r[3])) for r in found], removed_words(docs, window))


def test_substrings_stop_without_candidates(spark):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)] + [(90, "a b c"), (91, None)]
    found = rows(substrings.remove_repeats(frame(spark, docs)))
    same([(r[0], r[1], r[2], bytes(r[3])) for r in found], removed_words(docs, 20))


def test_leftmost_least():
    rng = random.Random(2)
    for width in (1, 2, 3, 5, 8, 11, 16):
        values = [rng.randrange(6) for _ in range(60)]
        found = substrings.leftmost_least(np.array(values, np.uint64), width)
        assert found.tolist() == [min(range(p, p + width), key=lambda j: (values[j], j)) for p in range(61 - width)]


def removed_bytes(docs, length):
    count = Counter(t[j : j + length] for _, text in docs for t in [(text or "").encode()] for j in range(len(t) - length + 1))
    out = []
    for doc_id, text in docs:
        t = (text or "").encode()
        gone = [False] * (len(t) + 1)
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize(("length", "limit"), [(400, 1 << 20), (60, 500), (3, 1)])
def test_suffixes(spark, docs, length, limit):
    found = rows(suffixes.remove_repeats(frame(spark, docs), length, chunk_bytes=limit))
    same([(*r[:4], bytes(r[4])) for r in found], removed_bytes(docs, length))


def thue_morse(k):
    a, b = b"a", b"b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_suffixes_tell_thue_morse_texts_apart(spark):
    a, b = (x.decode() for x in thue_morse(10))
    docs = [(1, a), (2, b), (3, "x" + a[:700]), (4, "y" + b)]
    found = rows(suffixes.remove_repeats(frame(spark, docs), 1024))
    same([(*r[:4], bytes(r[4])) for r in found], removed_bytes(docs, 1024))
    assert {r[0] for r in found if r[2]} == {2, 4}


def test_suffixes_remove_passages_of_the_length_alone(spark):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    docs, expected = [], {}
    for k, size in enumerate((300, 398, 399, 400, 401, 900)):
        passage = letters(size)
        for side in (0, 1):
            docs.append((2 * k + side, letters(50 + k) + "<" + "[{"[side] + passage + "]}"[side] + letters(60)))
            expected[2 * k + side] = size if size >= 400 else 0
    assert {r[0]: r[2] for r in rows(suffixes.remove_repeats(frame(spark, docs)))} == expected


def test_difference_covers():
    for r in range(5):
        v, cover = suffixes.difference_cover(r)
        assert len(cover) == 6 * r + 4
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_bpe(spark, docs, limit):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(frame(spark, docs), ranks, public_tokenizers.PATTERN, chunk_bytes=limit), ranks)
    table = {t: i for t, i in bpe.rank_table(ranks).items()}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    same([(r[0], tuple(r[1]), bytes(r[2])) for r in rows(found)], [(i, tuple(whole.encode_ordinary(t or "")), (t or "").encode()) for i, t in docs])


def test_packed_tokens_are_those_of_the_file(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    for _, t in docs + [(0, "a <|endoftext|> b"), (1, " lead"), (2, "trail "), (3, "x \n y  \t z"), (4, "  w 　v")]:
        assert np.frombuffer(packing.tokens((t or "").encode(), path), "<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids


def test_packed_ids_are_those_of_the_library_as_it_is(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    asked = docs + [(900, f"a {mark} b"), (901, mark), (902, f"{mark}{mark}\n"), (903, f"x  {mark}  y\n{mark} z "), (904, f"é{mark[:-1]} {mark}語")]
    for _, t in asked:
        assert np.frombuffer(packing.ids_of((t or "").encode(), path), "<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids
    wanted = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in asked[-5:]}
    found = rows(packing.pack(frame(spark, asked[-5:]), path, 2, 1024, with_ids=True))
    assert {r[0]: (r[2], r[3], r[4], bytes(r[5])) for r in found} == {i: (0, len(wanted[i]) // 4, zlib.crc32(wanted[i]), wanted[i]) for i, _ in asked[-5:]}


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing(spark, docs, capacity):
    path = public_tokenizers.path("byte_bpe_50k.json")
    placed = rows(packing.pack(frame(spark, docs), path, 2, capacity))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for doc_id, piece, start, length, crc, _, sequence, offset in placed:
        by_sequence[sequence].append((offset, length))
        by_doc[doc_id].append((piece, start, length, crc))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for doc_id, t in docs:
        ids = np.append(np.frombuffer(packing.tokens((t or "").encode(), path), "<u4"), 2).astype("<u4")
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        wanted.update((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((d, *p) for d, parts in by_doc.items() for p in parts) == wanted
    total = sum(r[3] for r in placed)
    assert len(by_sequence) <= max(-(-total // capacity) * 1.2, -(-total // capacity) + 1)


def test_packing_plan_uses_exact_complements():
    assert sorted(packing.plan({7: 2, 3: 2}, 10)) == [((7, 3), 2)]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [((6, 3, 1), 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 40): rng.randint(1, 50) for _ in range(25)}
        made = packing.plan(counts, 40)
        used = Counter()
        for lengths, times in made:
            assert sum(lengths) <= 40
            assert times > 0
            for x in lengths:
                used[x] += times
        assert used == Counter(counts)


def brute_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    near = [(200 + i, " ".join(["w%d" % j for j in range(900)][: 900 - i])) for i in range(12)]
    docs = docs + near
    prints = [brute_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    found = rows(simhash.near_duplicates(frame(spark, docs)))
    same([(i, f % 2**64, c) for i, f, c in found], [(docs[i][0], prints[i], least[group[i]]) for i in range(len(docs))])


def test_simhash_links_lose_no_pair():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(30)})
    links = simhash.forest(np.array(fps, np.uint64), 3, block=64)
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in links:
        assert (u ^ v).bit_count() <= 3
        group[find(u)] = find(v)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    group = list(range(600))
    for u, v in edges:
        a, b = group[u], group[v]
        group = [min(a, b) if g in (a, b) else g for g in group]
    found = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {i: g for i, g in enumerate(group) if g != i}


def test_language_id(spark):
    speak = {"en": "the quick brown fox jumps over the lazy dog and then rests in the shade of trees", "de": "der schnelle braune fuchs springt über den faulen hund und ruht dann im schatten der bäume"}
    rng = random.Random(1)
    say = lambda lang, n: " ".join(rng.choice(speak[lang].split()) for _ in range(n))
    learned = [(i, say(lang, 60), lang) for i, lang in enumerate(["en", "de"] * 20)] + [(90, None, "en"), (91, "x", None)]
    model = langid.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    assert list(model.dictionaries) == ["de", "en"] or list(model.dictionaries) == ["en", "de"]
    asked = [(1, say("en", 40)), (2, say("de", 40)), (3, None), (4, ""), (5, "12 !?"), (6, say("de", 4000)), (7, "½ ²"), (None, say("en", 30)), (8, "THE DOG!! AND!! THE FOX!! RESTS!!")]
    found = rows(langid.predict(frame(spark, asked), model))
    assert [(r[0], r[1]) for r in found] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, "und"), (None, "en"), (8, "en")]
    assert all(0 <= r[2] <= 1 for r in found)
    assert [r[3] for r in found] == [r[1] == "und" for r in found]
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert rows(langid.predict(frame(spark, asked[:1]), nothing)) == [(1, "und", 0.0, True)]


def test_toxicity(spark):
    rng = random.Random(4)
    mild = [f"w{i}" for i in range(200)]
    say = lambda bad, n=80: " ".join(rng.choice(["idiotic", "worthless", "disgusting"]) if bad and rng.random() < 0.05 else rng.choice(mild) for _ in range(n)) + (" worthless" if bad else "")
    docs = [(i, say(i % 5 == 1)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(400)] + [(None, 0, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    table = frame(spark, docs)
    model = toxicity.fit(table, labels)
    asked = [(1000, say(True)), (1001, say(False)), (1002, "w1 w2 w3 w9 you w17 are w5 idi0tic worthles w8 w7"), (1003, None), (1004, ""), (None, say(False))]
    found = {r[0]: r[1:] for r in rows(toxicity.score(frame(spark, asked), model))}
    assert found[1000][1] == 1
    assert found[1002][1] == 1  # misspellings that were never seen
    assert found[1001][1] == found[None][1] == 0
    assert found[1003] == found[1004]
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in found.values())
    none = toxicity.fit(table, labels.where("false"))
    assert rows(toxicity.score(frame(spark, asked[:1]), none)) == [(1000, 0.0, 0)]


def test_toxicity_reads_words_of_any_length():
    rng = random.Random(14)
    mild = [f"w{i}" for i in range(200)]
    say = lambda bad: [rng.choice(["idiotic", "worthless", "disgusting"]) if bad and rng.random() < 0.2 else rng.choice(mild) for _ in range(80)]
    model = toxicity.train([(" ".join(say(i % 2)).encode(), i % 2) for i in range(400)])
    long = "".join(rng.choice(mild) for _ in range(30))
    clean, toxic = (model.score((long + tail).encode()) for tail in ("w1w2w3w4w5w6w7", "worthlessidioticdisgusting"))
    assert toxic > clean + 0.05
    for word in (long, "語" * 30 + "馬鹿野郎" + "文" * 30, ".".join(mild[:40])):
        bare = word.replace(".", "")
        grams = {f"<{bare}>"[i : i + n] for n in (3, 4, 5) for i in range(len(bare) + 3 - n)} | {bare}
        assert set(toxicity.entries(word, 1 << 60)) == {xxhash.xxh3_64_intdigest(g) % (1 << 60) for g in grams}


def test_mpeg_round_trip_and_damage():
    rng = random.Random(6)
    for n in (0, 1, 63, 64, 1400, 1417, 1418, 9000):
        payload = bytes(rng.randrange(256) for _ in range(n))
        stored = mpeg.write(payload)
        s = mpeg.read(stored)
        assert mpeg.carried(s) == payload
        assert (s.wrong, s.lost) == (0, 0)
        assert s.table["frames"] == len(s.offsets)
        assert s.seconds == len(s.offsets) * 1152 / 32000
        assert all(mpeg.header(stored[o : o + 4]) for o in s.offsets)
    stored = mpeg.write(bytes(range(256)) * 40)
    offsets = mpeg.read(stored).offsets
    junk = b"\xff\xfbjunk" * 5
    damaged = stored[: offsets[2]] + junk + stored[offsets[2] :] + b"TAG" + b"name".ljust(125, b"\0")
    s = mpeg.read(damaged)
    assert s.lost == len(junk)
    assert len(s.offsets) == len(offsets)
    flipped = bytearray(stored)
    flipped[offsets[1] + 4] ^= 1
    assert mpeg.read(bytes(flipped)).wrong == 1
    assert mpeg.read(None).seconds == 0
    assert mpeg.read(b"no audio at all").lost == 15
    for version, layer, bits in ((1, 1, 0xFF), (1, 2, 0xFD), (2, 3, 0xF3), (2.5, 3, 0xE3)):
        h = mpeg.header(bytes((0xFF, bits, 0x90, 0x00)))
        assert (h.version, h.layer) == (version, layer)
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00))).size == 417


def test_mpeg_keeps_payloads_with_the_letters_of_a_tag():
    tag = b"TAG" + b"name".ljust(125, b"\0")
    for n in (64, 128, 1408, 1472, 3008):
        for k in range(3, min(n, 400) + 1):
            payload = b"S" * (n - k) + b"TAG" + b"E" * (k - 3)
            stored = mpeg.write(payload)
            for stream in (stored, stored + tag):
                s = mpeg.read(stream)
                assert mpeg.carried(s) == payload
                assert len(mpeg.carried(s)) == int(s.tags["TIT2"])
                assert (s.wrong, s.lost, len(s.offsets)) == (0, 0, s.table["frames"])
    cut = mpeg.read(stored[:-40] + tag)  # a last frame that is cut before a real tag
    assert len(cut.offsets) == cut.table["frames"] - 1
    assert cut.lost > 0
    assert mpeg.read(b"no audio" + tag).tags == {"TIT2": "name"}


def test_media(spark, docs):
    found = rows(media.describe(media.store(frame(spark, docs))))
    wanted = []
    for doc_id, t in docs:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wanted.append((doc_id, len(raw), len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    same([r[:5] for r in found], wanted)
    assert len({r[5:8] for r in found}) == len({t or "" for _, t in docs})


def test_lz_fingerprints(spark, docs):
    for ranges in (1, 5):
        found = rows(lzprint.compare(frame(spark, docs), ranges=ranges))
        order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, (d[1] or "").encode()))
        wanted = []
        for k, (doc_id, t) in enumerate(order):
            t, following = t or "", order[(k + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            a, b, c = (lzprint.fingerprint(x.encode()) for x in (t, edited, following))
            wanted.append((doc_id, len(t), sha256(edited.encode()).hexdigest(), lzprint.shown(a), lzprint.shown(b), lzprint.likeness(a, b), lzprint.likeness(a, c)))
        same(found, wanted)
    plain = rows(lzprint.fingerprints(frame(spark, docs)))
    assert {(r[0], r[3]) for r in found} == set(plain)


def test_lz_likeness_estimates_shared_phrases():
    rng = random.Random(9)
    a = [rng.getrandbits(45) for _ in range(3000)]
    b = a[:1500] + [rng.getrandbits(45) for _ in range(1500)]
    estimate = lzprint.likeness(lzprint.signature(lzprint._mixed(a)), lzprint.signature(lzprint._mixed(b)))
    assert abs(estimate - 1 / 3) < 0.2


def test_url_filters(spark):
    day = datetime.date
    entries = [("example.com", day(2024, 1, 10), "block"), ("example.com", day(2024, 2, 1), "allow"), ("a.example.com", day(2024, 1, 20), "block"), ("a.example.com", day(2024, 1, 20), "allow"), (None, day(2024, 1, 1), "block"), ("x.org", None, "block")]
    captures = [
        (1, "http://www.example.com/x", day(2024, 1, 9)), (2, "http://WWW.Example.com:80/x", day(2024, 1, 10)), (3, "https://example.com", day(2024, 2, 1)), (4, "http://u:p@a.example.com/y?z", day(2024, 3, 1)),
        (5, None, day(2024, 1, 15)), (6, "http://example.com/", None), (7, "nonsense", day(2024, 1, 15)), (8, "http://localhost/", day(2024, 1, 15)), (2, "http://WWW.Example.com:80/x", day(2024, 1, 10)), (None, "http://b.a.example.com/", day(2024, 1, 20)),
    ]
    table = spark.createDataFrame([(*c, "m", 3) for c in captures], "page_id long, url string, fetched_on date, m string, domain int")
    lists = spark.createDataFrame(entries, "domain string, listed_on date, status string")
    found = [(r.page_id, r.matched_domain, r.status, r.kept) for r in urlfilters.filter_urls(table, lists).collect()]
    wanted = [(1, None, None, True), (2, "example.com", "block", False), (2, "example.com", "block", False), (3, "example.com", "allow", True), (4, "a.example.com", "block", False), (5, None, None, True), (6, None, None, True), (7, None, None, True), (8, None, None, True), (None, "a.example.com", "block", False)]
    same(found, wanted)
    assert urlfilters.filter_urls(table, lists.where("false")).where("NOT kept").count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    ranks, path = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    model = langid.LanguageModel({})
    for df in (
        langid.predict(none, model), simhash.near_duplicates(none), bpe.encode(none, ranks, public_tokenizers.PATTERN), media.describe(media.store(none)), packing.pack(none, path),
        substrings.remove_repeats(none), toxicity.score(none, toxicity.train([])), lzprint.compare(none), suffixes.remove_repeats(none),
        urlfilters.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_on date"), spark.createDataFrame([], "domain string, listed_on date, status string")),
    ):
        assert df.count() == 0


def test_addresses_have_no_parents(spark):
    day = datetime.date(2024, 5, 1)
    entries = spark.createDataFrame([(d, day, "block") for d in ("3.4", "2.3.4", "1.2.3.5", "example.com.", "[::1]", "7")], "domain string, listed_on date, status string")
    urls = ["http://1.2.3.4/", "http://1.2.3.5:80/x", "http://www.example.com./", "http://example.com/", "http://[::1]:8080/a", "http://[::2]/", "http://5.6.7/"]
    table = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    found = {r.page_id: (r.host, r.matched_domain) for r in urlfilters.filter_urls(table, entries).collect()}
    assert found == {
        0: ("1.2.3.4", None), 1: ("1.2.3.5", "1.2.3.5"), 2: ("www.example.com", "example.com"), 3: ("example.com", "example.com"),
        4: ("[::1]", "[::1]"), 5: ("[::2]", None), 6: ("5.6.7", None),
    }


def id3(major, frames, flags=0):
    body = b"".join(frames)
    return b"ID3" + bytes([major, 0, flags]) + bytes(len(body) >> shift & 127 for shift in (21, 14, 7, 0)) + body


def test_media_of_others(spark):
    stored = mpeg.write(b"x" * 64)
    audio = stored[mpeg.read(stored).offsets[0] :]
    song = b"TIT2" + (8).to_bytes(4, "big") + b"\0\0\0My Song"
    old = b"TT2" + (8).to_bytes(3, "big") + b"\0My Song"
    marked = b"TIT2" + (5).to_bytes(4, "big") + b"\0\0\0A\xff\x00B"
    assert mpeg.read(id3(3, [song]) + audio).tags == {"TIT2": "My Song"}
    assert mpeg.read(id3(2, [old]) + audio).tags == {"TIT2": "My Song"}
    assert mpeg.read(id3(3, [marked[:7] + b"\4" + marked[8:]], 0x80) + audio).tags == {"TIT2": "A\xffB"}
    assert mpeg.read(bytes((0xFF, 0xFC, 0x90, 0)) + bytes(716) + bytes((0xFF, 0xFC, 0x90, 0))).checked == 0  # layer II
    rows_ = [(1, 0, id3(3, [song]) + audio), (2, 0, audio), (3, 0, id3(2, [old]) + audio), (4, 0, None), (5, 0, b"")]
    found = {r.doc_id: r for r in media.describe(spark.createDataFrame(rows_, "doc_id long, n_bytes long, media binary")).collect()}
    assert [found[i].frames for i in range(1, 6)] == [1, 1, 1, 0, 0]
    assert all(r.payload_bytes == 0 for r in found.values())


def plain_lz78(data):
    """The phrases of an LZ78 parse, as byte strings; the unfinished last one counts."""
    seen, phrase, out = set(), b"", []
    for k in range(len(data)):
        phrase += data[k : k + 1]
        if phrase not in seen:
            seen.add(phrase)
            out.append(phrase)
            phrase = b""
    return out + ([phrase] if phrase else [])


def test_lz_parse_is_lz78(docs):
    def name(phrase):
        h = 0
        for byte in phrase:
            h = (h * lzprint._FACTOR + byte + 1) & lzprint._MASK
        return h

    for _, t in docs:
        data = (t or "").encode()
        phrases: set[int] = set()
        last, new = lzprint.parse(data, phrases)
        wanted = plain_lz78(data)
        assert [*new, *([last] if last else [])] == [name(p) for p in wanted]
        values = [int(x) for x in lzprint._mixed([name(p) for p in wanted])] if wanted else []
        least = [min((v for v in values if v >> 58 == b), default=None) for b in range(lzprint.BINS)]
        shown = []
        for b in range(lzprint.BINS):
            step = next((k for k in range(lzprint.BINS) if least[(b + k) % lzprint.BINS] is not None), None)
            shown.append(0 if step is None else ((least[(b + step) % lzprint.BINS] >> 20) % 65535 + 1 + (0 if step == 0 else (b - (b + step) % lzprint.BINS) % lzprint.BINS)) % 65536)
        assert lzprint.fingerprint(data).tolist() == shown


def test_packing_ranks_in_parts(spark):
    pieces = spark.createDataFrame([(i, 0, 7 if i % 3 else 4, i) for i in range(300)], "doc_id long, piece int, length long, ids_crc32 long")
    placed = rows(packing.place(pieces, 11, each=10))
    used = defaultdict(list)
    for _, _, length, _, sequence, offset in placed:
        used[sequence].append((offset, length))
    assert len(placed) == 300
    assert all(sum(x for _, x in parts) <= 11 and sorted(parts) == [(a, b) for a, b in zip(np.cumsum([0, *(x for _, x in sorted(parts))]).tolist(), [x for _, x in sorted(parts)])] for parts in used.values())
    assert len(used) == 200


def test_language_sample_is_that_of_a_plain_sort(spark):
    rng = random.Random(3)
    learned = [(" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 90))), rng.choice(["en", "de", None])) for _ in range(300)]
    learned += learned[:40] + [(None, "en"), ("qq " * 5000, "fr"), ("zz zz zz", "it")]
    df = spark.createDataFrame(learned, "text string, lang string")
    model = langid.fit(df, per_language=20, shortest=50, longest=200, salts=7)
    hashed = {t: h for t, h in df.selectExpr("text", "xxhash64(text)").collect()}
    counts = Counter(lang for t, lang in learned if t is not None and lang is not None)
    wanted = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        first = sorted({(not 50 <= len(t) <= 200, hashed[t], t) for t, other in learned if other == lang and t is not None})[:20]
        wanted[lang] = b" ".join(langid.letters(t.encode()) for _, _, t in sorted(first, key=lambda x: x[1]))[: 1 << 16]
    assert model.dictionaries == {lang: c for lang, c in wanted.items() if len(c) >= 8}
    assert list(model.dictionaries) == [lang for lang in wanted if len(wanted[lang]) >= 8]
    assert list(langid.fit(df, most_languages=1).dictionaries) == [next(iter(counts))] or len(langid.fit(df, most_languages=1).dictionaries) == 1


def test_language_sample_of_many_texts_is_that_of_a_plain_sort(spark):
    rng = random.Random(5)
    learned = [(f"{i} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice((5, 30)))), "en" if i % 3 else "de") for i in range(1500)]
    learned += [("the one text that most rows have " * 3, "en")] * 1500
    df = spark.createDataFrame(learned, "text string, lang string")
    model = langid.fit(df, per_language=20, shortest=50, longest=200)
    hashed = {t: h for t, h in df.selectExpr("text", "xxhash64(text)").collect()}
    for lang in ("en", "de"):
        first = sorted({(not 50 <= len(t) <= 200, hashed[t], t) for t, other in learned if other == lang})[:20]
        assert model.dictionaries[lang] == b" ".join(langid.letters(t.encode()) for _, _, t in first)


def test_language_prediction_is_the_least_sum():
    import zstandard

    model = langid.LanguageModel({"en": b"the quick brown fox jumps over the lazy dog " * 20, "de": b"der schnelle braune fuchs springt " * 20}, block=64)
    for text in ("The QUICK fox, jumps!", "Der Fuchs springt; schnelle 12 braune", "fox fuchs " * 50, "x", "Ünïcödé 語 and the dog" * 9):
        clean = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        sums = {}
        for lang, content in model.dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sums[lang] = sum(len(plain.compress(clean[i : i + 64])) for i in range(0, len(clean), 64))
        best, second = sorted(sums.values())
        lang, score, rejected = model.predict(text.encode())
        assert sums[lang] == best
        assert score == 1 - best / second
        assert rejected == (second < best * 1.005)


def plain_training(sample, buckets, dims, epochs, rate, rare, floor, doubt, seed):
    """The training of toxicity.train, one entry at a time."""
    from math import exp, sqrt

    bags = [(Counter(e for w in raw.decode().split() for e in toxicity.entries(w, buckets)), y) for raw, y in sample]
    seen = Counter(e for bag, _ in bags for e in bag)
    common = sorted(e for e in seen if seen[e] >= 2 + len(sample) // rare)
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.1, (len(common), dims)).astype(np.float32)
    table = {e: [float(x) for x in row] for e, row in zip(common, start)}
    table_sq = dict.fromkeys(common, floor)
    soft, bias = rng.normal(0, 0.1, (dims, 2)).astype(np.float32).tolist(), [0.0, 0.0]
    soft_sq, bias_sq = [[1e-8] * 2 for _ in range(dims)], [1e-8] * 2
    share = [({e: n / sum(bag.values()) for e, n in bag.items() if e in table}, y) for bag, y in bags]
    for _ in range(epochs):
        order = rng.permutation(len(share))
        for at in range(0, len(order), 64):
            part = [share[i] for i in order[at : at + 64] if share[i][0]]
            g_soft, g_bias, g_table = [[0.0] * 2 for _ in range(dims)], [0.0] * 2, defaultdict(lambda: [0.0] * dims)
            for bag, y in part:
                hidden = [sum(table[e][d] * s for e, s in bag.items()) for d in range(dims)]
                z = [bias[c] + sum(hidden[d] * soft[d][c] for d in range(dims)) for c in (0, 1)]
                total = sum(exp(x - max(z)) for x in z)
                p = [exp(x - max(z)) / total - doubt / 2 - (1 - doubt) * (c == y) for c, x in enumerate(z)]
                for c in (0, 1):
                    g_bias[c] += p[c]
                    for d in range(dims):
                        g_soft[d][c] += hidden[d] * p[c]
                for e, s in bag.items():
                    for d in range(dims):
                        g_table[e][d] += s * sum(p[c] * soft[d][c] for c in (0, 1))
            for e, g in g_table.items():
                table_sq[e] += sum(x * x for x in g) / dims
                table[e] = [x - rate * y / sqrt(table_sq[e]) for x, y in zip(table[e], g)]
            for c in (0, 1):
                bias_sq[c] += g_bias[c] ** 2
                bias[c] -= rate * g_bias[c] / sqrt(bias_sq[c]) if part else 0
                for d in range(dims):
                    soft_sq[d][c] += g_soft[d][c] ** 2
                    soft[d][c] -= rate * g_soft[d][c] / sqrt(soft_sq[d][c]) if part else 0
    return {e: sum(v[d] * (soft[d][1] - soft[d][0]) for d in range(dims)) for e, v in table.items()}, bias[1] - bias[0]


def test_toxicity_training_is_that_of_a_plain_version():
    rng = random.Random(11)
    sample = [((" ".join(rng.choice(["mild", "calm", "word", "thing", "awful" if y else "nice"]) for _ in range(rng.randint(0, 12)))).encode(), y) for y in [0, 1] * 50]
    options = dict(buckets=1 << 10, dims=2, epochs=2, rate=0.3, rare=600, floor=1e-2, doubt=0.05, seed=7)
    model = toxicity.train(sample, **options)
    weights, bias = plain_training(sample, **options)
    assert np.isclose(model.bias, bias, atol=1e-3)
    assert set(np.flatnonzero(model.weights)) <= set(weights)
    assert np.allclose([model.weights[e] for e in weights], list(weights.values()), atol=1e-3)
    text = b"awful nice thing unknownword"
    found = [e for w in text.decode().split() for e in toxicity.entries(w, 1 << 10)]
    assert np.isclose(model.score(text), 1 / (1 + np.exp(-(model.bias + sum(model.weights[e] for e in found) / len(found)))))


def test_toxicity_takes_repeated_rows_and_very_long_texts(spark):
    model = toxicity.train([((("awful vile " if y else "calm mild ") * 20).encode(), y) for y in [0, 1] * 100])
    asked = [(1, "awful vile " * 60_000), (1, "awful vile " * 60_000), (2, "calm " * 200_000), (3, "calm mild"), (3, "calm mild"), (3, "awful")]
    found = rows(toxicity.score(frame(spark, asked), model))
    assert Counter((i, p) for i, _, p in found) == Counter([(1, 1), (1, 1), (2, 0), (3, 0), (3, 0), (3, 1)])
    assert len({s for i, s, p in found if i == 1}) == 1


def test_language_id_takes_repeated_rows_and_very_long_texts(spark):
    model = langid.LanguageModel({"en": b"the quick brown fox jumps over the lazy dog " * 20, "de": b"der schnelle braune fuchs springt " * 20})
    asked = [(1, "the lazy dog " * 50_000), (1, "the lazy dog " * 50_000), (1, "der braune fuchs"), (None, None), (None, None)]
    assert Counter((r[0], r[1]) for r in rows(langid.predict(frame(spark, asked), model))) == Counter([(1, "en"), (1, "en"), (1, "de"), (None, "und"), (None, "und")])


def test_toxicity_model_keeps_nothing_of_its_sample():
    texts = [(f"w{i % 7} w{i % 11} " + ("idiotic worthless" if i % 4 == 0 else "kind words")) for i in range(200)]
    model = toxicity.calibrated([(t.encode(), int("idiotic" in t)) for t in texts])
    assert model.weights is not None
    assert model._known is model._grams is model._list is None


def test_packed_pieces_with_a_mark_share_the_memory_of_their_word():
    path = public_tokenizers.path("byte_bpe_50k.json")
    pack, known = packing._byte_encoder(path)
    known.clear()
    known.before.clear()
    for piece in ["unheardof,", "unheardof.", "naïve,", "x's,", "12,", "a..", ",", ".a", "don't", "Ωmega!", "word́,", "日本。", "", "a_b;", "q" * 40 + "?"]:
        assert known[piece] == pack(" " + piece)
    assert "unheardof" in known


def test_bpe_decodes_a_batch_in_parts(spark, monkeypatch):
    batch = bpe.pa.record_batch({"doc_id": [1, 2, 3, 4, 5, 6], "ids": bpe.pa.array([[1, 2], None, [], [3] * 9, [4], [5, 6, 7]], bpe.pa.list_(bpe.pa.int32()))})
    for most, sizes in ((1, [1, 2, 1, 1, 1]), (4, [3, 1, 2]), (100, [6])):
        parts = list(bpe._parts(batch, most))
        assert [len(p) for p in parts] == sizes
        assert bpe.pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert not list(bpe._parts(batch.slice(0, 0), 4))
