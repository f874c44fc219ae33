"""Extraction, language, tokenising, packing, archives and licences."""

import base64
import hashlib
import io
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strandlake.llm import html_extract, language_id, licences, packing, sentencepiece_codec, warc
from strandlake.llm.labelled_pages import LABELLED
from strandlake.llm.licence_templates import TEMPLATES

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t ", "a", "Hello, World's 1st day!", "ÀÉ ß ĳ ﬁ é Σας ΟΔΟΣ", "x\x85y\x1cz w", "<|endoftext|> a<|startoftext|>b", "日本語 текст 🎉", "ab" * 30_000, "a  b   c ▁ d", "it's they'll we've I'm 'sx 12 3.4", "\x00\x01"]


@pytest.fixture(scope="module")
def documents(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return real + [(10_000 + i, t) for i, t in enumerate(ODD)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, tier int, score int")


# --- main text


@pytest.fixture(scope="module")
def weights():
    return html_extract.learn(LABELLED)


def test_labelled_pages_are_extracted(weights):
    for page, main in LABELLED:
        assert html_extract.extract(page, weights) == main


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        ("<article><p>One &amp; two &#233; &notin; &unknown; x&ampy</p><p> a \n b\t c </p></article>", "One & two é ∉ &unknown; x&y\na b c"),
        ("<nav>a b</nav><article><h1>T</h1><p>first<p>second <i>in</i>line</article><footer>f</footer>", "T\nfirst\nsecond inline"),
        ("<article><p>kept words here and there</p><div class='comments'><p>reader words</p></div><p>more words</p></article>", "kept words here and there\nmore words"),
        ("<article><p>words of the text</p><script>if (a<b) {'</p>'}</script><style>x</style><!-- no <p>this</p> --><p>the end", "words of the text\nthe end"),
        ("<article title='a > b'><p class=\"x>y\">one two</p>", "one two"),
        ("<form><article><p>a page in a form</p></article></form>", "a page in a form"),
        ("<article><p>cut off in a tag</p><p cla", "cut off in a tag"),
    ],
)
def test_extraction_cases(weights, page, text):
    assert html_extract.extract(page, weights) == text


def test_long_pages_keep_everything(weights):
    lines = [f"line {i} of a page" for i in range(20_000)]
    page = "<nav>" + "<a href='x'>l</a>" * 500 + "</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>f</footer>"
    assert html_extract.extract(page, weights) == "\n".join(lines)
    html_extract.extract("<a =\"" * 20_000, weights)


def test_best_region_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == best


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_extract.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    page = "<nav>Home</nav><article><p>words of the text</p></article>"
    df = spark.createDataFrame([(1, "u", page, "x", -1), (1, "u", page, "x", -1), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert Counter(tuple(r) for r in html_extract.main_text(df).collect()) == Counter({(1, "u", "words of the text", 17): 2, (None, None, "", 0): 1})


# --- language


def test_language(spark, documents):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    extra = spark.createDataFrame([(i, t, None) for i, t in documents if i >= 10_000], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(table.select("doc_id", "text", "lang").unionByName(extra)).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert language_id.identify(table.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(nothing).collect()} == {"und"}


def test_texts_of_no_language_score_low(spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    names, best = language_id.score(model, ["Привет, как дела сегодня у вас?", "zqxj vkqz xwjq pfzk qxzj wqkx zjqv", "日本語のテキスト", "the of and that with on", "Der Hund und die Katze sind nicht in der", "Ó ciónezez la de los que para"])
    assert set(names) <= set(model.langs) and (best[:3] < 0.5).all() and (best[3:] > 0.9).all()


def test_predict_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(1, "the of and", 5, "mine")], "doc_id long, text string, score int, lang_pred string")
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    row = language_id.predict(docs, model, "l", "c").first()
    assert (row["score"], row["lang_pred"], row["l"]) == (5, "mine", "en")


def test_very_long_text_is_scored_whole(spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    names, _ = language_id.score(model, ["the of and " + "der die und nicht " * 200_000, "the of and"])
    assert names == ["de", "en"]


def test_language_scores_match_a_slow_sum(spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50))
    texts = ["Der Hund, die Katze!", None, "", "the of and"] * 3
    names, best = language_id.score(model, texts)
    for text, name, p in zip(texts, names, best, strict=True):
        if not text:
            assert (name, p) == ("und", 0)
            continue
        logs = model.prior.copy()
        codes = language_id._folded()[[ord(c) for c in " " + text + " "]]
        for order in model.orders:
            for g in language_id._grams(codes, order, model.logs.shape[1]):
                logs += model.logs[:, g]
        assert name == model.langs[int(np.argmax(logs))]
        n, buckets = sum(max(len(codes) - order + 1, 0) for order in model.orders), model.logs.shape[1]
        rest = np.exp(logs - logs.max()).sum() + np.exp(-n * np.log(buckets) - np.log(len(model.langs) + 1) - logs.max())
        if text == texts[-1]:  # grams that reach over a text's end belong to the text they begin in
            assert abs(p - 1 / rest) < 0.05


# --- packing


def test_packing_covers_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in documents}
    rows = packing.pack_documents(frame(spark, documents), WORD_FILE, shard_tokens=20_000).toPandas()
    for i, g in rows.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == np.concatenate([[0], np.cumsum(g["length"])[:-1]]).tolist()
        assert g["length"].sum() == len(want[i]) == g["doc_tokens"].iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(want[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(rows["doc_id"]) == set(want)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        size = int(g["length"].sum())
        assert g["offset"].tolist() == np.concatenate([[0], np.cumsum(g["length"])[:-1]]).tolist()
        assert size <= 2048 and size & (size - 1) == 0  # no padding at all
    assert packing.pack_documents(frame(spark, []), WORD_FILE).count() == 0


def test_pack_rules():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.choice([0, 1, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 60))]
        sequences = packing.pack(lengths)
        seen = Counter()
        for pieces in sequences:
            size = sum(p[2] for p in pieces)
            assert size & (size - 1) == 0 and size <= 2048
            for d, s, n in pieces:
                assert n > 0
                seen.update((d, k) for k in range(s, s + n))
        assert seen == Counter((d, k) for d, n in enumerate(lengths) for k in range(n))
        groups = packing.step_groups(sequences, 1 << 14)
        tokens = Counter()
        for g, pieces in zip(groups, sequences, strict=True):
            tokens[g] += sum(p[2] for p in pieces)
        assert all(t <= 1 << 14 for t in tokens.values())


# --- sentencepiece


def test_codec_parity(spark, documents):
    rows = sentencepiece_codec.encode_documents(frame(spark, documents), PIECE_FILE).collect()
    assert len(rows) == len(documents) and all(r["parity"] for r in rows)
    assert [i for (i, t), r in zip(sorted(documents), sorted(rows), strict=True) if not r["round_trip"]] == [10_000 + ODD.index("a  b   c ▁ d")]
    assert sentencepiece_codec.encode_documents(frame(spark, []), PIECE_FILE).count() == 0


def _message(*fields):
    """A protobuf message of (number, value) with int, float, bytes or str values."""
    out = b""

    def varint(n):
        got = b""
        while n > 127:
            got, n = got + bytes([n & 127 | 128]), n >> 7
        return got + bytes([n])

    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_parity(tmp_path, squeeze):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]]
    pieces += [(p, -1.0 - k / 7, 1) for k, p in enumerate(["▁", "▁the", "▁ca", "t", "c", "a", "at", "s", "▁s", "the", "h", "e", "▁a", "▁cats", "ca", "ts"])]
    data = b"".join(_message((1, _message((1, p), (2, s), (3, t)))) for p, s, t in pieces) + _message((2, _message((3, 1), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, squeeze), (5, 1))))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.Codec(str(path))
    rng = random.Random(2)
    texts = ["", "the cats sat", "  the   cat ", "é cat", *["".join(rng.choices("thecas  ", k=rng.randint(1, 30))) for _ in range(200)]]
    ids = codec.encode(texts)
    for t, own, back in zip(texts, ids, codec.decode(ids), strict=True):
        assert own.tolist() == other.encode(t), t
        assert back == other.decode(own.tolist())


def test_damaged_models_are_refused():
    with open(PIECE_FILE, "rb") as f:
        data = f.read()
    with pytest.raises((ValueError, IndexError)):
        sentencepiece_codec.parse_model(data[:-3])


# --- archives


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives_round_trip(spark, min_bytes):
    real = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = real + [(5000 + i, None, real[0][2]) for i in range(30)] + [(6000, "u\r\nx", None), (6001, "u", ""), (6002, "u", "ab"), (6003, "u", "ab"), (-4, "é", real[1][2])]
    df = spark.createDataFrame([(i, u, h, 1, "s") for i, u, h in pages], "page_id long, url string, html string, size int, sha string")
    got = {r["page_id"]: r for r in warc.archive(spark, df, min_bytes).collect()}
    first = {}
    for i, _, h in sorted(pages):
        first.setdefault((h or "").encode(), i)
    for i, _, h in pages:
        payload = (h or "").encode()
        again = first[payload] != i and len(payload) >= min_bytes
        assert tuple(got[i]) == (i, len(payload), digest(payload), "revisit" if again else "response", first[payload] if again else None)
    assert len(got) == len(pages)
    assert warc.archive(spark, df.limit(0)).count() == 0


def test_archives_of_repeated_and_missing_ids(spark):
    pages = [(1, "A"), (2, "A"), (2, "B"), (2, "B"), (None, "A"), (None, "C"), (None, "C"), (None, None), (3, "B"), (4, "D" * 70_000)]
    df = spark.createDataFrame([(i, "u", h, b"s", k) for k, (i, h) in enumerate(pages)], "page_id long, url string, html string, sha binary, again_id long")
    got = Counter(tuple(r) for r in warc.archive(spark, df).collect())
    want = Counter()
    for i, h in pages:
        first = min((j for j, g in pages if (g or "") == (h or "") and j is not None), default=None)
        again = first is not None and i != first
        want[(i, len(h or ""), digest((h or "").encode()), "revisit" if again else "response", first if again else None)] += 1
    assert got == want


def test_archive_format():
    records = [warc.record_bytes(i, f"http://x/{i}", (f"<p>{i} page of some words</p>" * 20).encode(), "D", None) for i in range(200)]
    data = warc.archive_bytes(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size < len(data) and data[8:12] == struct.pack("<I", 0xEC30A437)
    back = list(warc.read_archive(io.BytesIO(data), at_once=100))
    assert [int(f["WARC-Record-ID"][10:-1]) for f, _ in back] == list(range(200))
    assert len(data) < sum(map(len, records)) / 4
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    assert list(warc.read_archive(io.BytesIO(warc.archive_bytes(records[:1]))))[0][1]


# --- licences


def slow_licences(text, templates, threshold=0.8):
    """All regions of all templates, then the claims."""
    words = licences.words(text)
    grams = list(zip(words, words[1:], strict=False))
    found = []
    for name, texts in templates.items():
        for t in texts:
            w = licences.words(t.encode())
            own, m = Counter(zip(w, w[1:], strict=False)), len(w) - 1
            rank = lambda a, b: sum((Counter(grams[a:b]) & own).values())  # noqa: B023, E731
            if grams and 2 * rank(0, len(grams)) >= threshold * (len(grams) + m):
                found.append((rank(0, len(grams)), 2 * rank(0, len(grams)) / (len(grams) + m), name, 0, len(grams)))
            taken = []
            for c, s in sorted(((rank(i, i + m), i) for i in range(len(grams) - m + 1)), key=lambda x: (-x[0], x[1])):
                if c >= threshold * m and all(abs(s - o) * 2 >= m for o in taken):
                    taken.append(s)
                    found.append((c, c / m, name, s, s + m))
    best, claimed = {}, set()
    for c, d, name, a, b in sorted(found, key=lambda x: (-x[0] * x[1], x[2], x[3])):
        if 2 * len(claimed & set(range(a, b))) <= b - a:
            claimed |= set(range(a, b))
            best[name] = max(d, best.get(name, 0))
    return best


def test_licences_against_a_slow_scan():
    rng = random.Random(4)
    short = {k: [t for t in v if len(t) < 2500] for k, v in TEMPLATES.items()}
    scanner, every = licences.Scanner(short), [t for v in short.values() for t in v]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += [w for w in rng.choice(every).split() if rng.random() > rng.choice([0, 0.03, 0.08])] + rng.choices(["the", "license", "foo"], k=rng.randint(0, 6))
        text = " ".join(words).encode()
        got, want = scanner.scan(text), slow_licences(text, short)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_each_template_alone_is_its_own_licence():
    scanner, rng = licences.Scanner(TEMPLATES), random.Random(9)
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert scanner.scan(text.encode()) == {name: 1.0}
            words = text.split()
            if len(words) > 100:  # a copy with changed words, inside other text
                changed = ["".join(rng.choices("abcdef", k=6)) if rng.random() < 0.03 else w for w in words]
                assert scanner.scan(" ".join(["some", "prose"] * 40 + changed + ["more", "prose"] * 40).encode()).keys() == {name}


def test_two_licences_of_one_text_are_both_found():
    scanner = licences.Scanner(TEMPLATES)
    text = TEMPLATES["MIT"][0] + " and then " + TEMPLATES["BSD-2-Clause"][0] + " x " * 500 + TEMPLATES["Apache-2.0"][0]
    assert scanner.scan(text.encode()).keys() == {"MIT", "BSD-2-Clause", "Apache-2.0"}
    assert scanner.scan(b"foo " * 300_000 + TEMPLATES["Zlib"][0].encode()).keys() == {"Zlib"}


def test_licence_rows(spark):
    rows = [(1, TEMPLATES["MIT"][0]), (2, "prose " * 50 + "Licensed under CC BY-NC 4.0. more"), (3, None), (4, ""), (5, "license"), (6, "no licence here"), (7, "x " * 40_000 + TEMPLATES["ISC"][0])]
    got = {r["doc_id"]: r for r in licences.scan_documents(frame(spark, rows)).collect()}
    assert [got[i]["licence"] for i in range(1, 8)] == ["MIT", "CC-BY-NC-4.0", None, None, None, None, "ISC"]
    assert got[1]["dice"] == 1.0 and got[3]["licences"] == []
    assert licences.scan_documents(frame(spark, [])).count() == 0


def test_text_bytes_reads_slices_and_nulls():
    from strandlake.llm.common import text_bytes

    data, ends = text_bytes(pa.array(["aé", None, "b", ""]).slice(1))
    assert bytes(data) == b"b" and ends.tolist() == [0, 0, 1, 1]


def test_archives_of_few_or_long_records_have_a_dictionary():
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    page = lambda n: " ".join(rng.choices(words, k=n)).encode()
    for records in ([page(3000) for _ in range(4)], [page(60_000) for _ in range(9)]):
        assert warc.build_dictionary(records)
        wrapped = [warc.record_bytes(i, "http://x/", r, "", None) for i, r in enumerate(records)]
        assert [block for _, block in warc.read_archive(io.BytesIO(warc.archive_bytes(wrapped)))] == records
    assert warc.build_dictionary([b"<p>short</p>"]) == b""


@pytest.mark.parametrize("split", [None, packing.word_parts])
def test_thinned_caches_give_the_same_ids(split):
    from strandlake.llm.tokens import ChunkCache

    rng = random.Random(14)
    encode = packing.word_encoder(WORD_FILE)
    cache = ChunkCache(encode, split, limit=60)
    common = ["the", "of", "Apple,", "x1"]
    for _ in range(40):
        texts = [[w.encode() for w in rng.choices(common, k=20) + ["".join(rng.choices("abcDE,.", k=5)) for _ in range(rng.randint(0, 30))]] for _ in range(3)]
        ids, bounds = cache(texts)
        for chunks, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == [i for c in chunks for own in encode([c.decode()]) for i in own]
        assert all(c.encode() in cache.index for c in common)
