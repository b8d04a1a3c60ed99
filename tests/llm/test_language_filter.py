"""The language filter drops long junk that has letters, and keeps clean texts, short ones too."""

import base64
import random

from quern.llm import langid


def test_junk_with_letters_goes(spark):
    rng, rows = random.Random(2), []
    syllables = {"en": ["the", "ing", "wh", "ou", "er", "and"], "fr": ["eau", "ç", "qui", "é", "les", "ment"], "de": ["ung", "sch", "ß", "ü", "ein", "keit"]}
    text = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(n))
    for i in range(480):
        lang = rng.choice(list(syllables))
        rows.append((i, text(lang, rng.randint(20, 200)), lang))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), floor=True)
    clean = [(1000 + i, text(rng.choice(list(syllables)), n)) for n in (1, 2, 5, 30, 100, 400) for i in range(n * 1000, n * 1000 + 30)]
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    junk = [base64.b64encode(rng.randbytes(900)).decode(), rng.randbytes(900).hex(), letters(2000), " ".join(letters(6) for _ in range(200))]
    both = spark.createDataFrame([*clean, *((-i, t) for i, t in enumerate(junk, 1))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(both, model).collect()) == sorted(i for i, _ in clean)
