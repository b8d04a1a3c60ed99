"""Operators over pages, conversations and vectors, and the pipeline, against brute force."""

import hashlib
import math
import random
import struct
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import chat, topk, warc
from quern.llm.common import ASCII_LOWER


@pytest.fixture(scope="module")
def pages(spark):
    big, rng = "<html>" + "é" * 60, random.Random(1)
    rows = [(i, f"http://x/{i}", f"<p>{rng.random()}</p>" * rng.randint(1, 80)) for i in range(700)]
    rows += [(800, "u", big), (799, "u", big), (801, None, big), (799, "v", big), (802, "a\r\nb: c", "small"), (803, "", "small"), (804, "u", None), (805, "u", ""), (None, "u", "no id" * 40), (806, "u", "x" * 3_000_000), (-3, "u", "neg" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "first_id", "path", "n")}).repartition(3).cache()


def test_warc(pages, spark):
    rows = [(r["page_id"], r["html"] or "") for r in pages.select("page_id", "html").collect()]
    groups = defaultdict(list)
    for i, h in rows:
        groups[h].append(i)
    want = []
    for i, h in rows:
        raw = h.encode()
        first = min((x for x in groups[h] if x is not None), default=None)
        again = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, (tuple(r) for r in warc.roundtrip(pages).collect()))) == sorted(map(str, want))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.roundtrip(none).count() == 0


def test_archive_format(pages):
    files, folder = warc.archive(pages)
    seen = 0
    for f in files.collect():
        raw = open(f["path"], "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and len(raw) == f["n_bytes"]
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        at, n = 8 + size, 0
        while at < len(raw):  # every record is a frame of its own
            assert struct.unpack("<I", raw[at : at + 4])[0] == 0xFD2FB528
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = one.decompress(raw[at:])
            headers, payload = warc.parse_record(record)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and headers["WARC-Type"] in ("response", "revisit")
            at, n = len(raw) - len(one.unused_data), n + 1
        assert n == f["n_records"]
        seen += n
    assert seen == pages.count()
    texts = {r["page_id"]: (r["url"], r["html"]) for r in warc.read_archives(files, folder).collect()}
    assert texts[5] == ("http://x/5", pages.filter("page_id = 5").first()["html"]) and texts[802][0] == "a%0D%0Ab: c" and texts[801] == ("urn:page:801", None)


@given(st.text("\\#</turn>: \nAss é=", max_size=40), st.text("ab:\\#=\n", max_size=10))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible(text, role):
    def esc(t):
        for old, new in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
            t = t.replace(old, new)
        return t

    assert chat.unescape(esc(text)) == text and "</turn>" not in esc(text)
    name = chat.NAMES.get(role) or "=" + esc(role).replace(":", "\\:")
    assert chat.parse_piece(f"### {name}: {esc(text)}</turn>\n") == (role, text)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b\n### User: x"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "</turn>"), (2, 0, "judge: #1", "é\\"), (None, None, "system", ""), (3, 0, "user", "long " * 100_000)]
    rows += [(4, i, "assistant", f"t{i}") for i in range(900)] + [(5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(1), "messages": F.lit(2), "prompt_": F.lit(3)})
    got = {r["conv_id"]: r for r in chat.format_and_digest(chat.with_planted(df)).collect()}
    pieces = {r["conv_id"]: r["n"] for r in chat.format_turns(chat.canonical_turns(chat.with_planted(df))).groupBy("conv_id").agg(F.sum(F.length("piece")).alias("n")).collect()}
    by = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", chat.PLANTED_TEXT), (-7, 1, "assistant", chat.PLANTED_TEXT)]:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, held in by.items():
        held = sorted(held, key=lambda x: (x[0] is not None, x[0] or 0))  # the tie of 2 goes by what is written: "### =:" before "### =judge"
        turns, loss = "".join(f"{r}\n{x}\n" for _, r, x in held), "".join(x for _, r, x in held if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(held) and g["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"], g["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), pieces[c])
    assert chat.format_and_digest(df.filter("false")).count() == 0


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi","x":1},{"role":"assistant","content":null}],"id":3}',
        '{"prompt":"p","response":"r","meta":{"a":1}}',
        '{"instruction":"i","input":null,"output":"o"}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"question":"q","answer":"a"}',
        '{"foo":1}',
        "nope",
        None,
        '{"messages":[]}',
        '{"messages":[{"content":"q","role":"user"},{"from":"gpt","value":"not lost"}]}',
        '{"messages":[{"role":"system"},{"content":"x"},{"role":"user","content":"y"}]}',
        '{"messages":[{"role":"user","content":"q"},{"tool":"z"}]}',
        '{"messages":[{"role":"user","content":"q"},7,null]}',
        '{"prompt":"p","response":{"deep":[1, 2]},"messages":"none"}',
        '{"turn":4,"role":"user","text":"t"}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, j string")
    turns, rest = chat.canonical_turns_json(df, "j")
    assert sorted(map(tuple, turns.collect())) == [
        (0, 0, "user", "hi"), (0, 1, "assistant", ""), (1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "user", "i"), (2, 1, "user", ""),
        (2, 2, "assistant", "o"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "q"), (4, 1, "assistant", "a"),
        (10, 0, "system", ""), (10, 1, "", "x"), (10, 2, "user", "y"), (13, 0, "user", "p"), (13, 1, "assistant", '{"deep":[1,2]}'), (14, 4, "user", "t"),
    ]
    assert sorted(r["conv_id"] for r in rest.collect()) == [5, 6, 7, 8, 9, 11, 12]
    typed = spark.createDataFrame([(1, [("user", "x")])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in chat.canonical_turns(typed).collect()] == [(1, 0, "user", "x")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "conv_id long"))


def brute_top(rows, k, every):
    held = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in dict(held).items():
        if q is not None and q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in held if i != q), key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("dims", [3, 24])
def test_top_k(spark, dims, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # ties
    rows += [(2000, None), (2050, [None] * dims), (2100, [float("nan")] * dims), (2150, [float("inf")] + [0.0] * (dims - 1)), (2200, [0.0] * dims), (2250, [1.5, -2.0]), (None, rows[50][1]), (None, rows[100][1]), (2300, []), (-50, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("clash"), "pivot": F.lit(1)}).repartition(4)
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute_top(held, 5, 50)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 2.0])]
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema)).collect()} == brute_top(rows, 5, 50)
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)).count() == 0


@pytest.mark.parametrize(("scale", "whole"), [(1.0, True), (2.0**22, False)])
def test_top_k_is_exact(spark, scale, whole, monkeypatch):
    """Scores beyond 2**53, which doubles would round, and those beyond 64 bits, which are refused."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute_top(rows, 5, 50)
    assert whole or max(abs(r[3]) for r in want) > 2**53
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [2.0**24, 0.0]), (1, [2.0**24, 1.0])], "vec_id long, embedding array<double>"))


def test_pipeline(spark, tmp_path):
    rng, rows = random.Random(5), []
    syllables = {"en": ["the", "ing", "wh", "ou"], "fr": ["eau", "ç", "qui", "é"]}
    for i in range(160):
        lang = rng.choice(list(syllables))
        rows.append([i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(20, 200))), lang, rng.choice(["a", "b", "c"])])
    rows += [[200, rows[0][1], "en", "a"], [201, rows[0][1] + " tail", "en", "b"], [202, "12 !!", "en", "a"], [203, None, None, None], [204, "", "fr", "c"]]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        held[name] = docs = docs.cache()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: sorted(r["doc_id"] for r in d.collect()) for name, d in held.items()}
    assert ids["language_id"] == [r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert ids["exact_dedup"] == [i for i in ids["language_id"] if i != 0]
    assert ids["near_dedup"] == [i for i in ids["exact_dedup"] if i != 201]
    assert set(ids["source_mix"]) <= set(ids["near_dedup"])
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in held["source_mix"].collect())
    assert sum(r["length"] for r in held["packing"].collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held["packing"].count()


def test_lower_case_is_ascii_only():
    assert "AZÉaz".encode().translate(ASCII_LOWER).decode() == "azÉaz" and np.uint8(65) == ord("A")
