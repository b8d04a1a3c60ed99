"""The fit and the filter's floor come from all labelled rows, not from a sample."""

import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid


def brute(spark, rows):
    """The labelled rows in the order of landmarks, fitted in memory: all of them, and those not held back, which the others try."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keyed = df.select("text", "lang", (F.pmod(F.xxhash64("text", F.lit(6)), F.lit(4)) == 0).alias("held"), F.xxhash64("text", "lang").alias("h")).collect()
    keyed.sort(key=lambda r: (r["held"], r["h"]))
    x, labels = langid.presence([r["text"].encode() for r in keyed]), [r["lang"] for r in keyed]
    cut = sum(not r["held"] for r in keyed)
    tried = langid.fit(x[:cut], labels[:cut])
    best = np.sort([v.max() for v, i in zip(langid.normalised(x[cut:]) @ tried.weights, x[cut:], strict=True) if i[-1].sum() >= langid.HELD_GRAMS])
    low, median = best[int(len(best) * langid.BELOW)], best[len(best) // 2]
    return df, langid.fit(x, labels), min(0.5, low - (median - low) * langid.UNSURE_ROWS / len(best)), len(best)


def test_all_rows_are_learned(spark):
    rng, parts = random.Random(5), {"en": ["the", "ing", "wh", "ou"], "fr": ["eau", "qui", "les", "ou"]}
    text = lambda x: " ".join(rng.choice(parts[x]) + rng.choice("abcdefgh") for _ in range(rng.randint(10, 90)))
    labels = [rng.choice(["en", "en", "en", "fr"]) for _ in range(1400)]  # more than 400 of one, the bound of the former sample
    df, want, floor, held = brute(spark, [(i, text(x), x) for i, x in enumerate(labels)])
    got = langid.train(df.repartition(5), floor=True)
    asked = [text(x).encode() for x in parts] + [b"zebra", b"0"]
    assert got.languages == want.languages and np.allclose(langid.scores(got, asked), langid.scores(want, asked), atol=1e-4)
    assert held > 100 and abs(got.floor - floor) < 4 / langid.BINS
    assert (langid.train(df.repartition(5)).weights == got.weights).all()


def test_floor_of_a_histogram():
    values = sorted(random.Random(1).gauss(1, 0.3) for _ in range(5000))
    seen = {}
    for v in values:
        seen[int(v * langid.BINS // 1)] = seen.get(int(v * langid.BINS // 1), 0) + 1
    low = values[int(5000 * langid.BELOW)]
    want = min(0.5, low - (values[2500] - low) * langid.UNSURE_ROWS / 5000)
    assert abs(langid.held_back_floor(sorted(seen.items())) - want) < 2 / langid.BINS
    assert langid.held_back_floor([]) == -np.inf


def test_repeated_rows_are_one_landmark(spark):
    """A language of one text alone is learned, however often it occurs, and a single row too."""
    rows = [(i % 3, "only this text here", "aa") for i in range(2000)] + [(7, "another thing", "bb")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), floor=True)
    assert model.languages == ("aa", "bb")
    assert langid.scores(model, [b"only this text here", b"another thing"]).argmax(axis=1).tolist() == [0, 1]
