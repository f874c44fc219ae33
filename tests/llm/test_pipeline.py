"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from strandlake.llm import language_id

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key string, kept int"
STEP = dict(corpus_pipeline.STAGES)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def real(spark, n=120):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()][:n]


def rows(spark):
    """Documents of the smallest table with planted cases, null and repeated ids, and repeated rows."""
    own, rng = real(spark), random.Random(5)
    english = [t for _, t, lang in own if lang == "en" and len(t) > 900]
    words = " ".join(english).split()
    passage = " ".join(rng.choices(words, k=55))
    near = rng.choices(words, k=400)
    out = own + [(900, english[0], "en"), (901, english[0].upper(), "en"), (None, english[1], "en"), (902, english[2], "en"), (902, english[2], "en"), (902, english[3] + " end", "en")]
    out += [(910 + k, " ".join(rng.choices(words, k=60)) + " " + passage + " " + " ".join(rng.choices(words, k=60)), "en") for k in range(3)]
    for k in range(3):
        copy = list(near)
        copy[100 + k] = "changed"
        out.append((920 + k, " ".join(copy), "en"))
    return out + [(930, None, "en"), (931, "", None), (932, "12 34 ...", "en"), (933, "текст на русском языке", None), (None, None, None), (None, "the of and that with", "en"), (None, "the of and that with", "en")]


def frame(spark, found):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.25, "mine", k) for k, (i, t, lang) in enumerate(found)], SCHEMA)


def reread(spark, df, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def tags(df):
    return {r["kept"] for r in df.collect()}


def exact(found):
    keep = {}
    for k, (i, t, _) in enumerate(found):
        best = keep.get(fold(t))
        if best is None or (found[best][0] is None) or (i is not None and i >= found[best][0]):
            keep[fold(t)] = k
    return keep


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", fold(text)) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in fps}


def without_passages(texts, span=corpus_pipeline.REPEAT_BYTES, least=corpus_pipeline.REPEAT_WORDS):
    """What stays of each text: exact copies lose all, others their runs of repeated strings that hold ``least`` words."""
    seen, out = {}, {}
    data = {k: (t or "").encode() for k, t in texts.items()}
    for d in data.values():
        for k in range(len(d) - span + 1):
            seen[d[k : k + span]] = seen.get(d[k : k + span], 0) + 1
    for key, d in data.items():
        if len(d) >= span and sum(x == d for x in data.values()) > 1:
            out[key] = ""
            continue
        gone = np.zeros(len(d) + 1, dtype=bool)
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = True
        stays, k = b"", 0
        while k < len(d):
            end = k
            while end < len(d) and gone[end] == gone[k]:
                end += 1
            if not gone[k] or len(d[k:end].split()) < least:
                stays += d[k:end]
            k = end
        out[key] = stays.decode("utf-8", "ignore") if texts[key] is not None else None
    return out


def test_language_stage_rejects_what_no_language_fits(spark, tmp_path):
    found = rows(spark)
    out = STEP["language_id"](spark, reread(spark, frame(spark, found), tmp_path), FOLDER)
    gone = set(range(len(found))) - tags(out)
    assert {found[k][0] for k in gone} == {930, 931, 932, 933, None} and len(gone) == 5
    assert out.columns == frame(spark, []).columns and {r["score"] for r in out.collect()} == {0.25}


def test_exact_stage(spark, tmp_path):
    found = rows(spark)
    out = STEP["exact_dedup"](spark, reread(spark, frame(spark, found), tmp_path), FOLDER).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, fold(r["text"])) for r in out) == sorted((found[k][0] is None, found[k][0] or 0, t) for t, k in exact(found).items())
    assert len(out) < len(found) - 6


def test_simhash_stage(spark, tmp_path):
    found = rows(spark)
    out = STEP["simhash"](spark, reread(spark, frame(spark, found), tmp_path), FOLDER).collect()
    part = components({k: fingerprint(t) for k, (_, t, _) in enumerate(found)})
    of = {}
    for k in part:
        of.setdefault(part[k], []).append(k)
    assert sorted(part[r["kept"]] for r in out) == sorted(of)
    for r in out:
        members = [found[k][0] for k in of[part[r["kept"]]]]
        assert r["doc_id"] == min((i for i in members if i is not None), default=None)
    assert {920, 921, 922} & {r["doc_id"] for r in out} == {920}


def test_suffix_stage(spark, tmp_path):
    found = rows(spark)
    docs = frame(spark, found)
    out = STEP["suffix_dedup"](spark, reread(spark, docs, tmp_path), FOLDER)
    want = without_passages({k: t for k, (_, t, _) in enumerate(found)})
    got = {r["kept"]: r for r in out.collect()}
    assert out.columns == docs.columns and {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    planted = [k for k, (i, _, _) in enumerate(found) if i in (910, 911, 912)]
    assert all(len(found[k][1].split()) - len(want[k].split()) >= 54 for k in planted)
    clean = [k for k in range(100) if sum(found[k][1] == t for _, t, _ in found) == 1]
    assert sum(want[k] == found[k][1] for k in clean) > 0.8 * len(clean)


def test_packing_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    found, tokenizer = rows(spark), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = STEP["packing"](spark, reread(spark, frame(spark, found), tmp_path), FOLDER).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t, _ in found]
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    crcs = {zlib.crc32(x.tobytes()) for x in ids}
    assert all(r["ids_crc32"] in crcs for r in out if r["start"] == 0 and r["length"] == r["doc_tokens"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, tmp_path, name):
    docs = reread(spark, frame(spark, []), tmp_path)
    out = STEP[name](spark, docs, FOLDER)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_whole_pipeline(spark, tmp_path):
    """run() over a small table equals the stages in brute force, one behind the other."""
    found = [x for x in rows(spark) if x[0] is not None and x[0] != 902]
    folder = f"{tmp_path}/tables"
    frame(spark, found).drop("score", "row_key", "kept").write.parquet(f"file://{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{folder}").collect()
    model = language_id.fit(spark.read.parquet(f"file://{folder}/documents.parquet"))
    names, scores = language_id.score(model, [t for _, t, _ in found])
    left = [x for x, name, p in zip(found, names, scores, strict=True) if name != "und" and p > 0.5]
    left = [left[k] for k in sorted(exact(left).values())]
    part = components({i: fingerprint(t) for i, t, _ in left})
    texts = without_passages({i: t for i, t, _ in left if part[i] == i})
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    got = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == got.get(r["doc_id"], 0)
        got[r["doc_id"]] = r["start"] + r["length"]
        assert zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert got == {i: len(x) for i, x in want.items()}
    assert len(want) < len(left) < len(found) - 3
