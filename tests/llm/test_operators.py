"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from groundline.llm import chat, common, decontaminate, exact_dedup, mixing, repeats, seekable, simhash, substring_dedup, suffix_dedup, token_output, toxicity, warc

rng = random.Random(1)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def text(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = [text(120) for _ in range(12)]
PASSAGE = text(60)
DOCS = [
    (1, BASE[0], "en", "a"), (2, BASE[0], "en", "a"), (3, BASE[0].upper(), "en", None), (4, None, None, None), (5, "", "en", "b"), (6, "  \n ", "en", "b"), (7, BASE[1] + " " + PASSAGE, "en", "b"), (8, PASSAGE + "\n" + BASE[2], "de", "c"),
    (9, text(20_000), "en", "a"), (10, "ab " * 400, "en", "a"), (None, BASE[3], "en", "a"), (None, None, "en", "a"), (11, BASE[4], "en", "c"), (11, BASE[4], "en", "c"), (12, BASE[4].replace(" ", "  ", 1), "en", "c"), (13, "you idiot " + BASE[5] + " moron", "en", "a"), (14, "x", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: 0 for c in ("id", "h", "fp", "size", "begin", "bucket", "k", "n", "p", "o", "score", "component_id", "cover", "kind")}
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    for name, value in clash.items():
        df = df.withColumn(name, common.F.lit(value))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens(docs, empty, spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.default_vocabulary())
    manifest = token_output.write_tokens(docs, common.scratch(spark, "t"), frame_bytes=4096)
    got = sorted(token_output.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d[0] for d in DOCS), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    want = collections.Counter()
    for i, t, *_ in DOCS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    path = next(r.path for r in manifest.collect() if 9 in {x.doc_id for x in got if x.shard == r.shard})
    assert len(token_output.read_documents(path, [9])[9]) == next(r.n_tokens for r in got if r.doc_id == 9)
    assert token_output.read_tokens(token_output.write_tokens(empty, common.scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_whole_texts(special_as_text):
    from tokenizers import Tokenizer

    path = token_output.default_vocabulary()
    whole, encoder = Tokenizer.from_file(path), token_output.Encoder(path, special_as_text)
    if special_as_text:
        whole.encode_special_tokens = True
    else:
        assert np.frombuffer(encoder.encode(["hello <|endoftext|> world"])[0], "<u4").tolist() == [31373, 220, 50256, 995]
    parts = [" ", "  ", "\n", "a", "é", "1", "'s", "!", "\x1c", "\x85", " ", "漢", "<|endoftext|>", "Ġ", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for t, data in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_seekable_frames_are_checked(tmp_path):
    path = str(tmp_path / "a.zst")
    writer = seekable.Writer(path)
    for k in range(5):
        writer.frame(bytes([k]) * 1000)
    writer.close(b"index")
    assert seekable.Reader(path).frame(3) == b"\x03" * 1000 and seekable.Reader(path).index() == b"index"
    data = bytearray(open(path, "rb").read())
    data[writer.frames[0][0] + 10] ^= 255
    open(path, "wb").write(data)
    assert seekable.Reader(path).frame(0) == b"\x00" * 1000
    with pytest.raises(Exception):
        seekable.Reader(path).frame(1)


def test_chat(spark):
    turns = [(1, k, "user", f"t{k}") for k in range(3)] + [(2, k, "user", f"t{k}") for k in range(2)] + [(3, k, "user", f"t{k}") for k in range(3)] + [(4, 0, None, None), (5, 0, "user", "<|im_end|>"), (5, 0, "user", "<|im_end|>"), (None, 0, "a", "b")] + [(6, k, "u", str(k)) for k in range(600)] + [(7, k, "u", str(k)) for k in range(599)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("position", common.F.lit(1))
    got = {r.conv_id: r for r in chat.render(df, chat.collapse(df)).collect()}
    assert {k: (r.n_turns, r.copies) for k, r in got.items()} == {1: (3, 2), 4: (1, 1), 5: (2, 1), None: (1, 1), 6: (600, 1)}
    assert got[4].text == "<|im_start|>user\n<|im_end|>\n" and got[5].text.count("<|im_end|>") == 2
    assert got[6].text.count("<|im_start|>") == 600
    assert chat.render(df.limit(0), chat.collapse(df.limit(0))).count() == 0


def test_chat_ties_are_ordered_by_text(spark):
    r = random.Random(12)
    turns, want = [], set()
    for k in range(20):
        a, b = sorted((text(3, r) + f" {k}", text(4, r) + f" {k}"))
        turn = None if k % 3 == 0 else 5
        turns += [(2 * k, turn, "user", a), (2 * k + 1, turn, "user", b), (2 * k + 1, turn, "user", a)]
        want.add(2 * k + 1)
    turns += [(100, None, "user", "first"), (100, 0, "user", "second"), (101, None, "user", "first"), (102, 0, "user", "second")]
    df = spark.createDataFrame(r.sample(turns, len(turns)), "conv_id long, turn long, role string, text string").repartition(5)
    kept = chat.collapse(df)
    assert {x.conv_id for x in kept.collect()} == want | {100, 102}
    assert next(x.text for x in chat.render(df, kept).collect() if x.conv_id == 100).index("first") < 40


def test_chat_of_one_long_conversation_without_turn_numbers(spark):
    rows = [(1, None, "u", f"t{k:05d}") for k in range(3000)] + [(2, None, "u", f"t{k:05d}") for k in range(2999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert [(x.conv_id, x.n_turns) for x in chat.collapse(df).collect()] == [(1, 3000)]


def test_warc_of_long_urls_and_repeated_rows(spark):
    body = "<p>é</p>" * 40
    pages = [(1, "u" * 100_000, body), (2, "v", body), (2, "w", body), (2, "w", body), (None, "n", "x"), (None, "n", "x"), (3, "z", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_bundles(df, common.scratch(spark, "w"), frame_bytes=300)
    ids = []
    for m in manifest.collect():
        reader = seekable.Reader(m.path)
        own = warc.pa.ipc.open_stream(reader.index()).read_all().column("record_id").to_pylist()
        for i in own:
            fields, _, payload, _ = warc.parse(memoryview(warc.read_record(m.path, i)), 0)
            assert fields["WARC-Record-ID"] == i
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Refers-To"] == warc._uri(1, hashlib.sha256(body.encode()).hexdigest())
        ids += own
    assert len(ids) == len({*ids}) == len(pages)
    assert sorted(r.page_id or 0 for r in warc.read_bundles(manifest).collect()) == [0, 0, 1, 2, 2, 2, 3]


def test_warc(spark):
    body = "<p>é</p>" * 40
    pages = [(3, "http://a/ b", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (7, "u", body), (7, "u", body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", common.F.lit(""))
    manifest = warc.write_bundles(df, common.scratch(spark, "w"), frame_bytes=500)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(manifest).collect()), key=repr)
    want = []
    for i, _, html in pages:
        payload = (html or "").encode()
        again = len(payload) >= 100 and i is not None and i > 1
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.read_bundles(warc.write_bundles(df.limit(0), common.scratch(spark, "w"))).count() == 0


def test_warc_header_of_any_length():
    url = "http://a/" + "x" * 100_000
    data = b"before" + warc.record(7, url, b"<p>hi</p>", None)[1] + warc.record(8, "u", b"next", None)[1]
    fields, _, payload, end = warc.parse(memoryview(data), 6)
    assert fields["WARC-Target-URI"] == url and payload == b"<p>hi</p>"
    assert warc.parse(memoryview(data), end)[2] == b"next"


def test_exact(docs, empty):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in DOCS:
        groups[lower(t)].append(i)
    want = []
    for i, t, *_ in DOCS:
        same = groups[lower(t)]
        keep = max((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    for every in (True, False):
        got = [tuple(r) for r in exact_dedup.exact_groups(docs, digest_all=every, prefix_chars=8).collect()]
        cut = 5 if every else 4
        assert sorted((x[:cut] for x in got), key=repr) == sorted((x[:cut] for x in want), key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark, docs, empty):
    def left(rows):
        return sorted(tuple(r) for r in exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())

    assert left([(1, "x"), (2, "x"), (1, "unique text")]) == [(1, "unique text"), (2, "x")]
    assert left([(1, "x"), (1, "x")]) == [(1, "x")]
    assert left([(1, "Ab"), (1, "aB"), (3, "ba"), (None, "AB")])[1:] == [(3, "ba")]
    kept = exact_dedup.deduplicate(docs)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t, *_ in DOCS})
    assert {r.doc_id for r in rows if lower(r.text) == lower(BASE[0])} == {2} and exact_dedup.deduplicate(empty).count() == 0


def brute_components(fps, distance):
    forest = simhash.Forest()
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= distance:
                forest.join(a, b)
    return forest


def test_simhash(docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = simhash.linked(docs).collect()
    want = [(i, fp(t)) for i, t, *_ in DOCS]
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got), key=repr) == sorted(want, key=repr)
    forest = brute_components([f for _, f in want], 3)
    least = {}
    for i, f in want:
        if i is not None:
            least[forest.root(f)] = min(i, least.get(forest.root(f), i))
    assert all(r.component_id == least.get(forest.root(r.fp % (1 << 64))) for r in got)
    assert simhash.linked(empty).count() == 0


@pytest.mark.parametrize("distance, segments, bucket", [(3, 2, 64), (7, 4, 4000)])
def test_links_of_dense_fingerprints(spark, distance, segments, bucket):
    r = random.Random(distance)
    centre, fps = r.getrandbits(64), set()
    for _ in range(250):
        x = centre
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps | {r.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = collections.defaultdict(set)
    for row in simhash.components(simhash.links(nodes, distance, segments, bucket)).collect():
        got[row.root].add(row.node % (1 << 64))
    forest, want = brute_components(fps, distance), collections.defaultdict(set)
    for x in fps:
        want[forest.root(x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix(docs, empty):
    texts = [(i, (t or "").encode()) for i, t, *_ in DOCS]
    seen = collections.Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))

    def finish(b, cover):
        kept = suffix_dedup.remove(b, cover)
        return len(b), len(b) - len(kept), len(cover), hashlib.sha256(kept).hexdigest()

    want = [(i, *finish(b, repeats.merged(np.array(s, dtype=int), np.array(s, dtype=int) + 200))) for i, b in texts for s in [[k for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1]]]
    names = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = [tuple(r) for r in repeats.apply(docs, suffix_dedup.repeated(docs), finish, names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repeats.apply(empty, suffix_dedup.repeated(empty), finish, names).count() == 0


def test_maximal_repeats():
    r = random.Random(3)
    for _ in range(60):
        rows = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 14))) for _ in range(4)]
        places = collections.defaultdict(set)
        for k, row in enumerate(rows):
            for a in range(len(row)):
                for b in range(a + 3, len(row) + 1):
                    places[row[a:b]].add((k, a))
        want = set()
        for s, at in places.items():
            left = {rows[k][a - 1] if a else (k, a) for k, a in at}
            right = {rows[k][a + len(s)] if a + len(s) < len(rows[k]) else (k, a) for k, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(at))))
        assert {(n, tuple(at)) for n, at in suffix_dedup.maximal_repeats(rows, 3)} == want


def test_groups_have_all_their_occurrences(spark):
    r = random.Random(41)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = noise(300), noise(260)
    rows = [(1, noise(90) + p + noise(80)), (2, noise(50) + p + noise(70) + q), (3, q + noise(40) + p[40:280] + noise(60)), (4, noise(400)), (5, noise(30) + p + q + noise(10)), (5, "short"), (None, p + noise(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    places = collections.defaultdict(set)
    for i, t in rows:
        for k in range(len(t) - 199):
            places[t[k : k + 200]].add((i, k))
    seen = collections.defaultdict(set)
    text = {(i, len(t)): t for i, t in rows}
    by = {F_h: t for F_h, t in ((x.h, x.text) for x in df.select(common.F.xxhash64("text").alias("h"), "text").collect())}
    strings = {}
    for x in suffix_dedup.groups_of(df).collect():
        s = by[x.h][x.at : x.at + x.length]
        assert len(s) == x.length >= 200 and strings.setdefault(x.of, s) == s  # one string a group
        seen[x.of].add((x.doc_id, x.at))
    assert text and all(len(at) > 1 for at in seen.values())
    covered = {(i, k) for s, at in strings.items() for i, a in seen[s] for k in range(a, a + len(at) - 199)}
    assert covered == {x for at in places.values() if len(at) > 1 for x in at}
    for of, s in strings.items():  # no occurrence of a group's string is missing
        assert {(i, t.find(s)) for i, t in rows if s in t} <= seen[of]


def test_equal_hashes_of_different_bytes_are_told_apart(monkeypatch):
    r = random.Random(2)
    strings = [bytes(r.choice(b"abc") for _ in range(30)) for _ in range(3)]
    strings += [strings[0][5:25] + b"zz", b"q" + strings[1][3:28]]
    want = sorted(suffix_dedup.maximal_repeats(strings, 12))
    monkeypatch.setattr(repeats, "mix", lambda x: x & np.uint64(1))
    assert sorted(suffix_dedup.maximal_repeats(strings, 12)) == want and len(want) == 2


def test_matching_statistics():
    r = random.Random(11)
    for _ in range(40):
        strings = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(r.randint(2, 9))]
        owners = np.array([r.randrange(5) for _ in strings])
        index = substring_dedup.FMIndex(np.array(sum(strings, []), dtype=np.uint64), np.array([*map(len, strings)]), owners)
        which, under = np.arange(len(strings)), np.array([r.randrange(7) for _ in strings])
        got, begin = index.statistics(which, under)
        for k, s in enumerate(strings):
            pool = {tuple(t[a:b]) for t, o in zip(strings, owners) if o < under[k] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
            want = [max([n for n in range(1, len(s) - a + 1) if tuple(s[a : a + n]) in pool], default=0) for a in range(len(s))]
            assert got[begin[k] : begin[k] + len(s)].tolist() == want


def test_only_runs_with_a_shared_window_are_indexed(monkeypatch):
    r = random.Random(13)
    for _ in range(40):
        strings = [[r.randrange(3) for _ in range(r.randint(4, 12))] for _ in range(r.randint(1, 9))]
        owners = np.array([r.randrange(4) for _ in strings])
        windows = [{tuple(s[k : k + 4]) for k in range(len(s) - 3)} for s in strings]
        held, earlier = substring_dedup.shared_windows(np.array(sum(strings, []), dtype=np.uint64), np.array([*map(len, strings)]), owners, 4)
        assert held.tolist() == [any(a & b and o != p for b, p in zip(windows, owners)) for a, o in zip(windows, owners)]
        assert earlier.tolist() == [any(a & b and p < o for b, p in zip(windows, owners)) for a, o in zip(windows, owners)]
    sizes: list[int] = []

    class Index(substring_dedup.FMIndex):
        def __init__(self, text, lengths, owners):
            sizes.append(len(lengths))
            super().__init__(text, lengths, owners)

    monkeypatch.setattr(substring_dedup, "FMIndex", Index)
    monkeypatch.setattr(repeats, "in_shards", lambda rows, index, schema: index)
    run = substring_dedup.earlier_strings(None, 4)
    data = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 6, 7, 8, 9, 5, 6, 7, 9], dtype=np.uint64)
    # of one minimizer: the first and the second share 1 2 3 4, the others share nothing
    got = [row for batch in run(*(np.array([7] * 4), np.arange(4), np.arange(4), np.array([10, 20, 20, 30]), np.array([False, False, False, True])), np.array([5, 5, 4, 4]) * 8, data.tobytes()) for row in batch.to_pylist()]
    assert sizes == [2] and sorted((x["c"], x["flag"], x["from"], x["to"]) for x in got) == [(1, False, 1, 5), (3, True, 0, 4)]


def test_smaller_neighbours():
    r = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        v = r.integers(0, 6, n)
        low, high = substring_dedup.smaller_neighbours(v)
        assert low.tolist() == [max([j for j in range(i) if v[j] < v[i]], default=-1) for i in range(n)]
        assert high.tolist() == [min([j for j in range(i + 1, n) if v[j] < v[i]], default=n) for i in range(n)]


def test_substring(docs, empty):
    words = [(repeats.NO_ID if i is None else i, (t or "").encode().split()) for i, t, *_ in DOCS]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))

    def finish(b, cover):
        w = b.split()
        gone = {k for a, z in cover for k in range(a, z)}
        return len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()

    want = []
    for (i, w), (real, t, *_) in zip(words, DOCS):
        s = np.array([k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i], dtype=int)
        want.append((real, *finish((t or "").encode(), repeats.merged(s, s + 13))))
    names = "n_words long, n_removed long, kept string"
    got = [tuple(r) for r in repeats.apply(docs, substring_dedup.covered(docs), finish, names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repeats.apply(empty, substring_dedup.covered(empty), finish, names).count() == 0


def test_substring_of_passages_that_a_document_repeats(spark):
    r = random.Random(17)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    p, q = words(40), words(40)
    x, y = words(20), words(20)
    rows = [(1, words(30) + p + words(30)), (2, (x + p + y) * 2 + words(20)), (5, (y + q + x + words(5)) * 3), (5, x + q + y + x + q + y), (4, words(20) + q), (None, (y + p + words(1)) * 3), (None, y + p + y)]
    got = repeats.apply(spark.createDataFrame([(i, " ".join(w)) for i, w in rows] * 2, "doc_id long, text string"), substring_dedup.covered(spark.createDataFrame([(i, " ".join(w)) for i, w in rows] * 2, "doc_id long, text string")), lambda b, cover: (b.decode(), sum(e - a for a, e in cover)), "text string, n long").collect()
    length, late = substring_dedup.LENGTH, 1 << 62
    first = {}
    for i, w in rows:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, late), late if i is None else i)
    want = []
    for i, w in rows * 2:
        gone = {k + j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < (late if i is None else i) for j in range(length)}
        want.append((i or 0, " ".join(w), len(gone)))
    assert sorted((r.doc_id or 0, r.text, r.n) for r in got) == sorted(want)


def test_mixing(docs, empty):
    rows = mixing.taken(*mixing.mix(docs, block_words=7)).collect()
    assert len(rows) == len(DOCS) and all(r.taken <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target)
    again = mixing.taken(*mixing.mix(docs, block_words=1000)).collect()
    assert sorted(map(repr, (r[:-1] for r in again))) == sorted(map(repr, (r[:-1] for r in rows)))
    assert mixing.taken(*mixing.mix(empty)).count() == 0


def test_every_stretch_of_the_schedule_is_near_the_weights(spark):
    plan = [("a", 50_000, 60_000.0), ("b", 40_000, 25_000.0), ("c", 9_000, 15_000.0), (None, 0, 0.0)]
    slots = sorted((r.slot, r.k, r.block) for r in mixing.schedule(spark, plan, 8).collect())
    needed = [7500, 3125, 1875, 0]
    assert [sum(k == s for _, k, _ in slots) for s in range(4)] == needed
    for s in range(3):
        assert [b for _, k, b in slots if k == s] == [*range(needed[s])]
        count, worst = 0, 0.0
        for i, (_, k, _) in enumerate(slots, 1):
            count += k == s
            worst = max(worst, abs(count - i * needed[s] / sum(needed)))
        assert worst < 8  # a random order strays by about 50


def test_mixing_tells_the_first_slot(docs):
    placed, pieces = mixing.mix(docs, block_words=7)
    got = mixing.taken(placed, pieces).collect()
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    at = {(r.k, r.begin): r.slot for r in pieces.groupBy("k", "begin").agg(common.F.min("slot").alias("slot")).collect()}
    assert sorted(r.first_slot for r in got if r.taken) == sorted(at[r.k, r.begin] for r in placed.collect() if (r.k, r.begin) in at and r["size"])


def test_targets():
    r = random.Random(2)
    for _ in range(100):
        sizes, weights = [r.randint(0, 50) for _ in range(5)], [r.choice((1, 2, 5)) for _ in range(5)]
        got = mixing.targets(sizes, weights)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
        level = {t / w for t, s, w in zip(got, sizes, weights) if t < 2 * s - 1e-9}
        assert not level or max(level) - min(level) < 1e-9


def test_decontamination(spark, docs, empty):
    item = [text(40) for _ in range(3)]
    benchmark = spark.createDataFrame([(1, item[0]), (2, item[1] + " Answer: " + text(3)), (3, None), (4, "zz yy")], "item_id long, text string")
    r = random.Random(9)
    changed = " ".join(w if r.random() > 0.1 else "qq" for w in item[0].split())
    leaks = spark.createDataFrame([(100, BASE[6] + " " + item[0] + " " + BASE[7]), (101, BASE[8] + " " + changed), (102, "a zz yy b"), (None, item[0].upper())], "doc_id long, text string")
    found = decontaminate.contaminated(docs.select("doc_id", "text", "h").unionByName(leaks.withColumn("h", common.F.lit(0))), benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(100, 1), (101, 1), (102, 4), (None, 1)}
    assert decontaminate.contaminated(empty, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.lcs([1, 2, 3, 2], [3, 1, 2, 2]) == 3


def test_sums_of_terms_and_blocks():
    """Rows are summed group after group's place, not group after group; a term of many places goes through pieces."""
    r = np.random.default_rng(3)
    rows = r.integers(-9, 9, (500, 5)).astype(np.float32)
    for n in (0, 1, 7, 5000):
        block = np.sort(r.integers(0, 500, n))
        ids = np.where(r.random(n) < 0.5, 3, r.integers(1, 500, n))  # half of all places are one term's
        blocks, terms = np.zeros((500, 5)), np.zeros((500, 5))
        for i, b in zip(ids, block):
            blocks[b] += rows[i]
            terms[i] += rows[b]
        assert (decontaminate._summed(ids, block, 500, rows) == blocks).all()
        some, sums = decontaminate._gathered(ids, block, rows)
        got = np.zeros((500, 5))
        got[some] += sums
        assert (got == terms).all() and some.tolist() == sorted({*ids.tolist()})
    assert decontaminate.PIECE < 2500


def test_decontamination_against_brute_force(spark):
    """Every document against every item at every place, by the decision alone."""
    r = random.Random(31)
    items = [text(r.choice((12, 20, 35, 60)), r) for _ in range(12)]
    rows = []
    for k in range(60):
        words = text(r.randint(20, 150), r).split()
        if k % 2:
            item = r.choice(items).split()
            words[(at := r.randrange(len(words))) : at] = [w if r.random() > (k % 7) / 15 else r.choice(WORDS) for w in item]
        rows.append((k, " ".join(words)))
    coded = {w: n + 1 for n, w in enumerate(sorted({w for t in items for w in decontaminate.words_of(t)}))}
    want = set()
    for k, t in rows:
        ids = decontaminate.code(t, coded).tolist()
        for n, item in enumerate(items):
            words, answer = ([coded[w] for w in decontaminate.words_of(x)] for x in (item, decontaminate.answer_of(item)))
            near = [ids[a : a + len(words) + 10] for a in range(max(1, len(ids) - len(words) + 1))]
            if any(decontaminate.lcs(words, x) >= decontaminate.COVERED * len(words) and decontaminate.lcs(answer, x) >= decontaminate.ANSWER * len(answer) for x in near):
                want.add((k, n))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)][::-1], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect()}
    assert want and len(want & got) >= 0.95 * len(want) and got >= {(k, n) for k, n in want if items[n] in rows[k][1]}
    parts = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark, max_items=5).collect()}
    assert parts >= {(k, n) for k, n in want if items[n] in rows[k][1]} and len(want & parts) >= 0.95 * len(want)
    assert [len(g) for g in decontaminate.item_groups([(n, t, decontaminate.words_of(t)) for n, t in enumerate(items)], 5, 10**6)] == [5, 5, 2]


def test_verbatim_items_need_no_cosine(spark):
    r = random.Random(4)
    items = [text(n, r) for n in (2, 3, 5, 16, 16, 17, 40, 90)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(100 + k, text(r.randint(40, 80), r) + f" {item.upper()}, " + text(r.randint(40, 80), r)) for k, item in enumerate(items)] + [(k, text(150, r)) for k in range(20)] + [(200, " ".join(items[4].split()[:8])), (201, " ".join(items[4].split()[8:])), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(df, benchmark, cosine=2.0).collect()}
    assert {k for k, x in found.items() if x.covered == 1} == {(100 + k, k) for k in range(len(items))}
    assert all(0 < found[100 + k, k].cosine <= 1.001 for k in range(3, len(items))) and not {d for d, _ in found} & {200, 201, 202}
    loose = {(x.doc_id, x.item_id): x.covered for x in decontaminate.contaminated(df, benchmark).collect()}
    assert all(loose[k] >= x.covered for k, x in found.items())


def test_several_fingerprints_link_what_any_of_them_does(spark, empty):
    rng, texts = np.random.default_rng(3), []
    for k in range(12):
        base = [f"w{k}x{j}" for j in rng.integers(0, 5000, 120)]
        for _ in range(6):
            some = list(base)
            for at in rng.integers(0, 120, 3):
                some[at] = f"n{rng.integers(0, 10**9)}"
            texts.append(" ".join(some))
    texts += ["", None, texts[0], "one"]
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(None, texts[1], "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp1 string")
    got = {r.doc_id: r.component_id for r in simhash.linked(docs, 5, 7, 4, 3).collect()}
    prints = [simhash.fingerprints_of(t, 5, 3) for t in texts]
    forest = simhash.Forest()
    for a in range(len(texts)):
        for b in range(a):
            if any((x ^ y).bit_count() <= 7 for x, y in zip(prints[a], prints[b])):
                forest.join(a, b)
    assert {k: got[k] for k in range(len(texts))} == {k: forest.root(k) for k in range(len(texts))}
    assert got[None] == got[1]
    one = {r.doc_id: r.component_id for r in simhash.linked(docs, 5, 7, 4).collect()}
    assert len({*got.values()}) < len({*one.values()})
    assert simhash.linked(empty, 5, 7, 4, 3).count() == 0


def test_groups_of_similar_sets():
    r = np.random.default_rng(8)
    for _ in range(60):
        sets = [np.empty(0, np.uint64)]
        for _ in range(6):
            base = r.integers(0, 10**9, int(r.integers(3, 40))).astype(np.uint64)
            for _ in range(int(r.integers(1, 7))):
                base = base.copy()
                base[r.integers(0, len(base), max(1, len(base) // 9))] = r.integers(0, 10**9)
                sets.append(np.unique(base))
        forest = simhash.Forest()
        for a in range(len(sets)):
            for b in range(a):
                x, y = {*sets[a].tolist()}, {*sets[b].tolist()}
                if len(x & y) >= 0.8 * max(1, len(x | y)):
                    forest.join(a, b)
        assert simhash.similar_groups(sets, 0.8).tolist() == [forest.root(k) for k in range(len(sets))]


def test_shouting_is_judged_on_the_whole_text():
    for text in ("a" * 3000 + "B" * 9000, "Ä" * 50 + "ß日\u01c5 1!", "", "quiet " * 500 + "LOUD " * 40):
        assert toxicity.letters_of(text) == (sum(map(str.isalpha, text)), sum(map(str.isupper, text)))
    late = "a" * 3000 + "B" * 9000
    assert toxicity.patterns_of(late, [late])[0]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (7, 0), (8, 0), (13, 1), (13, 0), (None, 1), (11, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, *model).collect()}
    assert got[13] >= 0.7 and max(s for i, s in got.items() if i != 13) < 0.7
    assert toxicity.scored(empty, *toxicity.train(empty, labels.limit(0))).count() == 0
    bare = toxicity.train(docs, labels.limit(0))
    assert {r.doc_id: r.score for r in toxicity.scored(docs, *bare).collect()}[13] > got[1]


def test_labels_of_the_held_out_fold_change_nothing(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, text(50, r) + (f" grulf{r.choice(['a', 'ib', 'um'])} x" if k % 5 == 0 else "")) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    out = []
    for turned in (False, True):
        labels = [(k, int((k % 5 == 0) != (turned and held(k)))) for k, _ in rows]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        out.append(sorted(tuple(x) for x in toxicity.op3_toxicity(spark, str(tmp_path)).collect()))
    assert out[0] == out[1]
    assert all(h == held(k) and p == (s >= 0.7) and 0 <= s <= 1 for k, h, s, p in out[0])
    assert np.mean([p == (k % 5 == 0) for k, h, s, p in out[0] if h]) > 0.97


def test_scores_pass_other_columns_through(spark):
    df = spark.createDataFrame([(1, "a", 7.5), (None, None, None)], "doc_id long, text string, score double")
    got = toxicity.scored(df, *toxicity.train(df, df.selectExpr("doc_id", "1 as toxic").limit(0)), keep=df.columns, name="tox").collect()
    assert [r.score for r in got] == [7.5, None] and all(r.tox < 0.7 for r in got)


def test_toxic_terms_are_mined(spark):
    r = random.Random(5)
    rows = [(k, text(60, r) + (f" vrok{r.choice(['a', 'ib', 'um'])} " + text(5, r) if k % 6 == 0 else "")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k, _ in rows], "doc_id long, toxic int")
    terms, weights = toxicity.train(docs, labels)
    assert "vrok-" in terms
    got = {x.doc_id: x.score for x in toxicity.scored(docs, terms, weights).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 6 == 0) for k in held]) > 0.98


def test_what_a_step_keeps_goes_with_it(spark):
    def seen(step):
        def run(batches):
            for batch in batches:
                made = []
                common.kept(step, lambda: made.append(1) or 7)
                yield common.pa.RecordBatch.from_pydict({"n": [len(made)], "held": [len(common._kept)]})

        return run

    one = spark.range(1).repartition(1)
    got = [tuple(one.transform(common.in_arrow, seen(step), "n long, held long", step).first()) for step in ("a", "a", "b", "a")]
    assert {held for _, held in got} == {1} and got[2:] == [(1, 1), (1, 1)]
