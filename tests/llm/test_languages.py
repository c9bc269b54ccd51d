"""Language identification with many languages and scripts of many letters."""

import numpy as np

from logjury.llm import language


def test_every_script_and_language_is_learned(spark):
    rng = np.random.default_rng(6)
    scripts = {"el": 0x3B1, "ru": 0x430, "ar": 0x628, "hi": 0x915, "zh": 0x4E00, "zh2": 0x5E00, "ja": 0x3042, "ko": 0xAC00}
    size = dict.fromkeys(scripts, 24) | {"zh": 900, "zh2": 900, "ko": 600}
    # Forty more languages of the same letters, each with words of its own.
    words = {f"l{k:02}": ["".join(map(chr, 97 + rng.integers(0, 26, 5))) for _ in range(40)] for k in range(40)}
    for lang, first in scripts.items():  # words of one length, so nothing but the letters tells them apart
        words[lang] = ["".join(map(chr, first + rng.integers(0, size[lang], 3))) for _ in range(400)]
    rows = []
    for lang, own in words.items():
        for _ in range(30 if lang != "l07" else 8):
            rows.append((len(rows), " ".join(rng.choice(own, 60)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs)
    assert model.languages == sorted(words)
    found = language.predict(docs, model, ["lang"]).collect()
    assert [r for r in found if r["lang_pred"] != r["lang"]] == []


def test_rows_of_steps_do_not_meet():
    rng = np.random.default_rng(1)
    for classes in (3, 50, 3000):
        sample = rng.integers(0, classes, 2000)
        row = language.automaton(sample, classes)
        model = language.Model("", ["x"], [row], [len(sample)])
        text = np.concatenate([sample[500:700], rng.integers(0, classes, 50)])
        _, _, count = model.phrases(text, np.array([0, len(text)]))
        own, at, want = "".join(map(chr, sample + 0x4E00)), 0, 0
        text = "".join(map(chr, text + 0x4E00))
        while at < len(text):
            stop = at + 1
            while stop < len(text) and text[at : stop + 1] in own:
                stop += 1
            at, want = stop, want + 1
        assert count[0, 0] == want
