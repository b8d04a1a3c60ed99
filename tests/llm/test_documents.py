"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import common, components, counters, dedup, encoding, jaccard, langid, lm_score, mixture, packing, shingles, token_file
from quern.llm.common import fresh_path, id_crc32

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "and", "of", "tion", "ing", "er", "Éau", "größe", "niño", "x,", "y.", "Zed"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", rng.choice(vocabulary)]) for _ in range(n))
    rows = []
    for i in range(40):
        rows.append([i, text(rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", "hot", "hot", "hot"]), 0])
    base = text(120).split(" ")
    for i in range(40, 60):  # near copies
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(99)}"
        rows.append([i, " ".join(own), "en", "hot", 0])
    rows += [[60, rows[3][1], "en", "hot", 0], [61, rows[3][1], "en", None, 0], [61, rows[3][1], "en", None, 0]]
    rows += [[62, None, None, None, None], [63, "", "en", "a", 0], [64, " \t\n ", "de", "b", 3], [None, "no id here at all", "en", "a", 1], [65, "one two", None, "é", 0], [66, "12 34 !?", "en", "a", 0]]
    rows += [[70, "a <|endoftext|> b<|startoftext|>c", "en", "a", 0], [71, "<|ENDOFTEXT|> <|endoftext", "en", "a", 0]]
    rows += [[67, "long " * 30_000 + "end", "en", "hot", 0], [68, "a\x00b ﷽ \U0001f600\x0b\x0cq", "en", "b", 0], [69, "One Two", None, "é", 0]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("digest", "id", "body", "words", "pos", "_key", "row", "target", "block", "cid", "n")}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    got = dedup.mark_duplicates(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for g in got:
        ids = groups[texts[g["text_sha256"]]]
        assert g["keep_id"] == max((i for i in ids if i is not None), default=None) and g["group_size"] == len(ids)
        kept[g["text_sha256"]] += g["kept"]
    assert set(kept.values()) == {1}
    out = dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r["text"] or "") for r in out.collect()) == sorted(groups)
    assert dedup.mark_duplicates(empty).count() == 0 == dedup.deduplicate(empty).count()


@pytest.mark.parametrize("hot", [2, 1000])
def test_dedup_deals_hot_groups(spark, hot, monkeypatch):
    """Joins by shuffles: a group that holds a third of all rows, rows that repeat an id and a text."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "HOT_ONE_IN", hot)
    rows = [(i, "hot" if i % 3 else f"t{i % 60}") for i in range(600)] + [(599, "hot")] * 90 + [(None, None)] * 80 + [(7, "once")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup.mark_duplicates(df).collect()
    sizes = Counter(t for _, t in rows)
    keep = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in sizes}
    digest = {hashlib.sha256((t or "").encode()).hexdigest(): t for t in sizes}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all((r["keep_id"], r["group_size"]) == (keep[digest[r["text_sha256"]]], sizes[digest[r["text_sha256"]]]) for r in got)
    assert Counter((r["doc_id"], digest[r["text_sha256"]]) for r in got if r["kept"]) == Counter((i, t) for t, i in keep.items())
    assert Counter(map(tuple, dedup.deduplicate(df).collect())) == Counter((i, t) for t, i in keep.items())


def test_dedup_compares_texts_of_one_digest(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(dedup.F, "sha2", lambda c, bits: F.substring(real(c, bits), 1, 1))  # collisions
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(120)], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup.mark_duplicates(df).collect()}
    assert got == {(i, 80 + i % 40, 3, i >= 80) for i in range(120)}


def brute_components(rows):
    sets, link = {}, {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        link[k] = k

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                link[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k in sets:
        least[find(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in least[find(k)] if i is not None), default=None)) for k in sets)


def test_jaccard(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one_each(docs).collect()}
    assert kept == {r["component_id"] for r in got} | {None}
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_of_edited_copies(spark, seed, monkeypatch):
    if seed % 2:  # every shingle is hot: the way of joins; all pairs and postings go in parts
        monkeypatch.setattr(jaccard, "HOT_LEVEL", 0)
        monkeypatch.setattr(jaccard, "PART_PAIRS", 2)
        monkeypatch.setattr(jaccard, "PART_POSTINGS", 3)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"w{rng.randrange(40 if g % 2 else 4000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(15):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["new"], ["more", "words"], [own[k]]])
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == brute_components(rows)


def test_jaccard_derives_answers_from_a_leaders(spark, monkeypatch):
    """Members like their leader, yet not linked with it: some link among each other, which only the differences show."""
    rng, derived, own = random.Random(11), [], jaccard._derived
    monkeypatch.setattr(jaccard, "_derived", lambda scratch, pairs, sets: derived.append(pairs.count()) or own(scratch, pairs, sets))
    base, rows = [f"w{i}" for i in range(200)], []
    for g in range(12):  # groups that each change the same quarter of the base in their own way
        start = rng.randrange(140)
        changed = base[:start] + [f"g{g}x{i}" for i in range(rng.choice([20, 30, 45]))] + base[start + 30 :]
        for _ in range(6):
            text = list(changed)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rows.append((len(rows), " ".join(base)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_components(rows) and derived and derived[0] > 0


@given(st.lists(st.text("aB \t\n,é", max_size=60), max_size=8), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_shingles_follow_words(texts, chunk):
    held, shingles._CHUNK = shingles._CHUNK, chunk
    try:
        made = shingles.shingle_sets([t.encode() for t in texts])
    finally:
        shingles._CHUNK = held
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    assert [len(s) for s in made] == [len(s) for s in want]
    both = [(a, b) for a in range(len(texts)) for b in range(a)]
    assert all(len(np.intersect1d(made[a], made[b])) == len(want[a] & want[b]) for a, b in both)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    link = {x: x for e in edges for x in e}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in edges:
        link[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_mixture(docs, empty, spark):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixture.mix_taken(docs, block_words=16).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while True:
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            rest -= target[s]
            open_.remove(s)
    by_size, taken = {float(sizes[s]): s for s in names}, defaultdict(int)
    assert len(by_size) == len(names)
    for r in got:
        s = by_size[float(r["source_size"])]
        assert math.isclose(r["target"], target[s], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, mixture.mix_taken(docs, block_words=16).collect())) == sorted(map(str, got))
    assert mixture.mix_taken(empty).count() == 0
    assert all(r["taken"] == 0 for r in mixture.mix_taken(spark.createDataFrame([(1, " ", None), (2, None, "a")], "doc_id long, text string, source string")).collect())


def test_schedule_is_spread_and_complete(docs):
    sized = docs.select("source", mixture.word_count(F.col("text")).alias("size"))
    targets = mixture.source_targets(sized)
    slots = mixture.schedule(targets, common.Scratch(docs.sparkSession), 16).collect()
    ranks = defaultdict(list)
    for r in sorted(slots, key=lambda r: r["slot"]):
        ranks[r["source_idx"]].append(r["rank"])
    need = {r["source_idx"]: -(-r["words"] // 16) for r in targets.collect()}
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in need.items() if n}
    total = sum(need.values())
    early = [r for r in slots if r["slot"] < total // 2]
    for k, n in need.items():
        assert abs(sum(r["source_idx"] == k for r in early) - n / 2) <= 4
    share = {k: n / total for k, n in need.items()}  # of every beginning, each source has its share but for the logarithm of its length in slots
    seen = Counter()
    for i, r in enumerate(sorted((r for r in slots if r["slot"] < total), key=lambda r: r["slot"]), 1):
        seen[r["source_idx"]] += 1
        assert all(abs(seen[k] - i * share[k]) <= 3 + math.log2(i) for k in share)


def test_mixed_documents_hold_what_is_taken(docs):
    out = mixture.mix_documents(docs, block_words=16)
    assert out.columns == docs.columns
    by_id = defaultdict(int)
    for r in out.collect():
        by_id[r["doc_id"]] += len(words(r["text"]))
    want = defaultdict(int)
    for r in mixture.mix_taken(docs, block_words=16).collect():
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in by_id.items() if v} == {k: v for k, v in want.items() if v}
    first = {r["doc_id"]: r["first_slot"] for r in mixture.mix_taken(docs, block_words=16).collect() if r["taken"]}
    order = list(dict.fromkeys(r["doc_id"] for r in out.collect() if r["doc_id"] != 61))
    assert [first[i] for i in order if i is not None] == sorted(first[i] for i in order if i is not None)  # the schedule's order


def test_mixture_of_repeated_ids(spark):
    """A third of all rows without id, some rows repeated whole: counted by group, never ordered one by one."""
    rows = [(None, "w " * (i % 3 + 1), "hot") for i in range(9000)] + [(i, "a b c", "x") for i in range(300)] + [(5, "again and again", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.lit(0)).repartition(4)
    got = mixture.mix_taken(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in ("hot", "x"):
        own = [r for r in got if (r["source_size"] == 18000) == (s == "hot")]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    taken = sum(r["taken"] for r in got)
    assert sum(len(r["text"].split()) for r in mixture.mix_documents(df).collect()) == taken


ALPHABET = "ab Z.,\n\t'1é Σ́#\x01\x00"


@pytest.mark.parametrize("path", [BYTE, WORDS])
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<"]), max_size=30).map("".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_is_the_tokenizers_own(path, texts):
    own = Tokenizer.from_file(path)
    assert [x.tolist() for x in encoding.encoder(path).encode(texts)] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets(spark):
    small, own = encoding.PieceEncoder(BYTE, cache_bits=8), Tokenizer.from_file(BYTE)
    texts = [f"w{i} x{i}, y{i}.\nZ{i}" for i in range(40)] + ["<|endoftext|>  two", "the " * 400_000]
    want = [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for t in texts for x in small.encode([t])] == want


def test_token_files(spark, docs, empty):
    own = Tokenizer.from_file(BYTE)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    path = fresh_path(spark, "test-tokens")
    token_file.write_tokens(docs, path, BYTE, 0, row_group_bytes=1 << 16)
    got = {}
    for r in token_file.digest_tokens(spark, path).collect():
        got.setdefault((r["doc_id"], r["start"]), r)
    at = 0
    for doc, text in rows:
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        g = got[doc, at]
        assert (g["n_tokens"], g["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    few = token_file.read_tokens(spark, path, 5, 6)
    assert {r["doc_id"] for r in few.collect()} == {5, 6} and "GreaterThanOrEqual(doc_id,5)" in few._jdf.queryExecution().toString()
    assert "array<int>" not in token_file.read_lengths(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert token_file.encode_and_digest(empty, BYTE, 0).count() == 0
    small = fresh_path(spark, "test-small-files")
    token_file.write_tokens(docs, small, BYTE, 0, file_bytes=4000)
    assert len(glob.glob(f"{small.removeprefix('file:')}/part-*")) > 8 and token_file.digest_tokens(spark, small).count() == len(rows)
    many = fresh_path(spark, "test-row-groups")
    token_file.write_tokens(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" x ")), 100).alias("text")), many, BYTE, 0, row_group_bytes=1 << 16)
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{many.removeprefix('file:')}/part-*")]
    assert min(m.num_row_groups for m in footers) > 1  # row groups are bounded
    for m in footers:
        for g in range(m.num_row_groups):
            chunks = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for c in chunks.values())
            assert "DELTA_BINARY_PACKED" in chunks["tokens.list.element"].encodings
            assert chunks["doc_id"].statistics is not None


def test_packing(spark, docs, empty):
    own = Tokenizer.from_file(WORDS)
    got = packing.pack(docs, WORDS, 2, group_pieces=16).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[r["doc_id"], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((g["doc_id"], g["start"], g["length"], g["ids_crc32"], g["doc_tokens"]) for g in got) == want
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, WORDS, 2).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tournament_is_first_fit(lengths):
    bins, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 50), len(bins))
        if b == len(bins):
            bins.append(0)
        want[i] = (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing(lengths, 50) == want


def test_language_id(spark, docs, empty):
    rng, rows = random.Random(2), []
    syllables = {"en": ["the", "ing", "wh", "ou"], "fr": ["eau", "ç", "qui", "é"], "de": ["ung", "sch", "ß", "ü"]}
    for i in range(240):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(3, 80))), lang))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled.filter(id_crc32(F.col("doc_id")) % 4 != 2))
    got = {r["doc_id"]: r for r in langid.predict(labelled, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(got) == 240 and sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    odd = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(odd) == 73 and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (62, 63, 64, 66))
    assert langid.predict(empty, model).count() == 0 == langid.keep_identified(empty, model).count()
    nothing = langid.train(labelled.filter("false"))
    assert nothing is None and {r["lang_pred"] for r in langid.predict(labelled, nothing).collect()} == {"und"}
    kept = langid.keep_identified(labelled.withColumn("_bytes", F.lit(1)), model)
    assert kept.count() == 240 and kept.columns == ["doc_id", "text", "lang", "_bytes"]


def test_kernel_is_the_blended_spectrum():
    texts = [b"abcab", b"abd", b"", b"zz zz"]
    got = langid.normalised(langid.presence(texts))
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            want = 0.0
            for n in langid.N_GRAMS:
                s, t = ({v[i : i + n] for i in range(len(v) - n + 1)} for v in (x, y))
                want += len(s & t) / math.sqrt(len(s) * len(t)) if s and t else 0
            assert math.isclose(float(got[a] @ got[b]), want, abs_tol=1e-5)


def test_fit_is_kernel_ridge_regression():
    """With every text a landmark, Nyström is exact: the scores are those of a dense weighted kernel ridge solve."""
    rng, parts = random.Random(7), {"en": ["the", "ing", "wh"], "fr": ["eau", "qui", "les"], "de": ["ung", "sch", "ein"]}
    labels = [rng.choice(["en", "en", "fr", "de"]) for _ in range(40)]
    text = lambda x: " ".join(rng.choice(parts[x]) + rng.choice("abcde") for _ in range(12)).encode()
    texts, asked = [text(x) for x in labels], [text(x) for x in ("en", "fr", "de")]
    model = langid.fit(langid.presence(texts), labels, landmarks=40)
    own, other = (langid.normalised(langid.presence(x)).astype(np.float64) for x in (texts, asked))  # the blended spectrum, as tested above
    k = own @ own.T
    w = np.array([len(labels) / len(model.languages) / labels.count(x) for x in labels])
    y = np.array([[1.0 if x == lang else -1.0 for lang in model.languages] for x in labels])
    alpha = np.linalg.solve(k + langid.RIDGE * len(labels) / 100 * np.diag(1 / w), y)
    want = (other @ own.T) @ alpha
    assert np.allclose(langid.scores(model, asked), want, atol=2e-3)


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"x{i % 200} word{i % 200}y", f"l{i % 200:03d}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(df).languages) == 200
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 199)
    with pytest.raises(ValueError, match="199 languages"):
        langid.train(df)


def brute_tables(texts):
    total = np.zeros(lm_score._STARTS[-1], np.uint64)
    for t in texts:
        padded = np.frombuffer(bytes(lm_score._PAD) + t, np.uint8)
        for start, keys in zip(lm_score._STARTS, lm_score.context_keys(padded), strict=False):
            for k in keys.tolist():
                total[start + k] += 1
    return total


def test_context_counts_cover_all_training_bytes(spark):
    texts = [b"abcabc", b"", b"x y", b"\xff\x00z" * 7]
    rows = counters.summed(lm_score.count_contexts(spark.createDataFrame([(bytearray(t),) for t in texts], "body binary").repartition(3)), lambda x: x)
    got = np.zeros((lm_score._STARTS[-1] // lm_score._PART, lm_score._PART), np.uint64)
    import zstandard

    for r in rows.collect():
        got[r["part"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.uint64)
    assert (got.reshape(-1) == brute_tables(texts)).all()


def brute_anchors(text):
    """place: key of the words before it, for the places that are anchors."""
    of, place, key = lm_score.anchors([text])
    assert not of.any()
    return dict(zip(place.tolist(), key.tolist(), strict=True))


def brute_score(tables, text, end, known=None):
    """One text, bit by bit, in doubles. known: key to (following, strength in steps)."""
    told, at = [(0, 0)] * len(text), brute_anchors(text) if known else {}
    for place, key in sorted(at.items()):
        if key in known:
            for i, c in enumerate(known[key][0][: len(text) - place]):
                told[place + i] = (c, known[key][1])
                if text[place + i] != c:
                    break
    nodes = [tables.reshape(-1)[i:j].reshape(-1, 256).astype(float) / lm_score._SCALE for i, j in zip(lm_score._STARTS[:-1], lm_score._STARTS[1:], strict=True)]
    keys = lm_score.context_keys(np.frombuffer(bytes(lm_score._PAD) + text, np.uint8))
    k = len(nodes) + 1
    weights = np.zeros((8, 2, k))
    weights[:, 0] = (*lm_score.FIRST_WEIGHTS, lm_score.ANCHOR_WEIGHT)
    refine = np.zeros((8, len(lm_score.KINKS)))
    cost, start, turn = 0.0, 0, 0
    while start < len(text):
        stop = min(len(text), start + (lm_score.SEGMENTS[turn] if turn < len(lm_score.SEGMENTS) else lm_score.LONGEST_SEGMENT))
        dw, dr = np.zeros_like(weights), np.zeros_like(refine)
        for at in range(start, stop):
            c, gate = text[at], int(at > 0 and bool(lm_score._IN_WORD[text[at - 1]]))
            gate = gate if at else int(lm_score._IN_WORD[0])
            for bit in range(8):
                node, sign = (1 << bit) | (c >> (8 - bit)), 2 * ((c >> (7 - bit)) & 1) - 1
                foretold, strength = told[at]
                right = foretold >> (7 - bit) == c >> (7 - bit)
                agree = 1 if right else -1 if foretold >> (8 - bit) == c >> (8 - bit) else 0
                x = np.array([*(sign * t[int(q[at]) >> 8, node] for t, q in zip(nodes, keys, strict=True)), agree * strength / lm_score._SCALE])
                y = float(x @ (weights[bit, 0] + gate * weights[bit, 1]))
                bends = np.clip(y, -np.array(lm_score.KINKS), np.array(lm_score.KINKS))
                final = min(30.0, max(-30.0, y + float(bends @ refine[bit])))
                wrong = 1 / (1 + math.exp(final))
                cost += math.log1p(math.exp(-final))
                dw[bit, 0] += wrong * x
                dw[bit, 1] += wrong * x * gate
                dr[bit] += wrong * bends
        weights += lm_score.RATE * dw / (stop - start)
        refine += lm_score.REFINE_RATE * dr / (stop - start)
        start, turn = stop, turn + 1
    return -cost / math.log(10) + len(text) * math.log10(1 - end) + math.log10(end)


def test_mixer_is_the_model_bit_by_bit():
    rng = random.Random(3)
    train = [" ".join(rng.choice(["the", "ing", "of the", "größe"]) for _ in range(50)).encode() for _ in range(20)]
    tables = lm_score.log_odds(brute_tables(train))
    texts = [b"", b"t", train[0], b"the unseen zebra of the " * 30, bytes(range(256))]
    got = lm_score.Mixer(tables, 0.01).score(texts)
    assert np.allclose(got, [brute_score(tables, t, 0.01) for t in texts], rtol=2e-4, atol=1e-3)


def test_anchors_foretell_what_follows(spark):
    """Anchors that occur twice foretell, exactly as bit by bit, and repeated texts get better."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).encode()
    twice, thrice, others = text(2000), text(1500), [text(300) for _ in range(4)]
    edited = twice[:700] + b"edit " + twice[720:]
    train = [twice, twice, thrice, thrice, thrice + b" and its own end", *others]
    rows = spark.createDataFrame([(i % 2, bytearray(t), False) for i, t in enumerate(train)] + [(0, bytearray(edited), True)], "block int, body binary, held_out boolean").repartition(3)
    counts = defaultdict(Counter)
    for t in train:
        for place, key in brute_anchors(t).items():
            assert t[place : place + 1] in (b" ", b"") and len(t[:place].split()) >= 4
            counts[key][t[place : place + lm_score.FOLLOWING]] += 1
    best = {k: max(((n, f) for f, n in c.items())) + (sum(c.values()),) for k, c in counts.items() if sum(c.values()) > 1}
    got = {(r["block"], r["key"]): (r["times"], bytes(r["following"]), r["of"]) for r in lm_score.known_anchors(lm_score.anchor_rows(rows)).collect()}
    assert {k for _, k in got} == set(best) and all(v == best[k] for (_, k), v in got.items()) and len(best) > 20
    assert all(len(brute_anchors(t)) > len(t.split()) / 160 for t in (twice, thrice))
    keys = list(best)
    hints = lm_score.Hints(np.array(keys), [best[k][1] for k in keys], np.array([best[k][0] for k in keys]), np.array([best[k][2] for k in keys]))
    tables = lm_score.log_odds(brute_tables(train))
    known = {k: (f, max(0, min(127, round(math.log((n + lm_score.ADDED) / (of - n + lm_score.ADDED)) * lm_score._SCALE)))) for k, (n, f, of) in best.items()}
    mixer, texts = lm_score.Mixer(tables, 0.01), [twice, edited, thrice, others[0], b"", b"w1"]
    with_hints, without = mixer.score(texts, hints), mixer.score(texts)
    assert np.allclose(with_hints, [brute_score(tables, t, 0.01, known) for t in texts], rtol=2e-4, atol=1e-2)
    assert with_hints[0] > 0.95 * without[0] and with_hints[2] > 0.95 * without[2] and with_hints[1] > without[1] and (with_hints[3:] == without[3:]).all()


def test_next_byte_chances_add_up_to_one():
    tables = lm_score.log_odds(brute_tables([b"abc abd " * 20]))
    mixer = lm_score.Mixer(tables, 0.01)
    before = b"abc ab" * 15
    scores = mixer.score([before + bytes([c]) for c in range(256)] + [before])
    total = (10 ** (scores[:-1] - (scores[-1] - math.log10(0.01)) - math.log10(0.01))).sum()  # each goes on, then ends
    assert math.isclose(total, 0.99, rel_tol=2e-3)


def test_lm_scores(spark, docs, empty):
    held = id_crc32(F.col("doc_id")) % 7 == 2
    got = lm_score.score_documents(docs, held).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    tokens = lambda t: [w.encode() for w in words(t)] + [b""]
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not is_held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        want[r["doc_id"], is_held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)] += 1
    assert Counter((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] < 0 and math.isfinite(g["score"]) for g in got)
    assert lm_score.score_documents(empty, held).count() == 0
    alone = lm_score.score_documents(spark.createDataFrame([(9, "abc")], "doc_id long, text string"), F.lit(True)).first()
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0) and math.isfinite(alone["score"])
