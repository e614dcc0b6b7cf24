import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from chartloom.llm import quality_model, quality_rules


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "é漢", "x", "longer-word", "😀"])
    some = lambda n: " ".join(word() for _ in range(n)) + "."
    out = [some(rng.randint(1, 60)) + "\n" * rng.randint(0, 2) + some(rng.randint(1, 60)) for _ in range(120)]
    junk = ["a | b | c | d", "BUY!! NOW!! IT!! IS!!", "x### y%%% z&&&", "All rights reserved.", "Home", "\t", ""]
    return out + ["\n".join(rng.choice(junk + out[:9]) for _ in range(8)) for _ in range(80)] + [None, "", " \n\t", "w " * 60_000, "a b c d e f g h " * 40]


def test_rules_against_plain_python(spark):
    rows = [(i, t, "e", "f") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, x string")
    out = {r.doc_id: r for r in quality_rules.rules(docs).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(t)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        lost = sum(len(re.sub(r"\s", "", x)) for x in (t or "").split("\n")) - sum(len(re.sub(r"\s", "", x)) for x in (r._clean or "").split("\n"))
        assert r.kept == (not failed and 100 * lost <= 50 * r.word_chars)
    assert quality_rules.rules(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    assert kept == {i: r._clean for i, r in out.items() if r.kept}


def test_lines(spark):
    bad = ["a | b | c | d e", "Home", " next ", "Licensed under the Apache License, Version 2.0.", "NOW!! BUY!!", "x### y$$$"]
    good = ["A plain sentence, with 5% of one sign.", "Wow! Really?", "He came home.", "a|b and so on and so forth", "The next one is here."]
    df = spark.createDataFrame([(x,) for x in bad + good], "x string").select("x", quality_rules.line_fails(F.col("x")).alias("f"))
    assert {r.x: r.f for r in df.collect()} == {x: x in bad for x in bad + good}


def test_machine_uses_pairs():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (1500, 2))
    examples = [(np.array([0, 1]), r * 2.0 - 1) for r in x]
    m = quality_model.Machine(4)
    m.fit(examples, (x[:, 0] ^ x[:, 1]).astype(float), epochs=60)
    at, value = np.tile([0, 1], len(x)), (x * 2.0 - 1).ravel()
    assert ((m.score(at, value, np.arange(0, 2 * len(x), 2)) > 0.5) == (x[:, 0] ^ x[:, 1])).mean() > 0.95
    v = m.factor[[0, 1]]
    plain = m.bias[0] + m.weight[:2] @ [1.0, -1.0] + v[0] @ v[1] * -1.0
    assert abs(m.raw(np.array([0, 1]), np.array([1.0, -1.0]), np.array([0]))[0] - plain) < 1e-9


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["sun", "river", "tree", "walks", "over", "the"]) for _ in range(60)).capitalize() + "."
    bad = lambda: " | ".join(rng.choice(["BUY", "sun!!", "river%%%"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), "en", "s") for i in range(600)] + [(600, None, None, None), (601, "", "en", "s"), (None, "x", "en", "s"), (3, "twice", "en", "s"), (602, "z " * 40_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.97
    again = quality_model.score(docs.repartition(5), quality_model.train(docs.repartition(3), labels)).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in out) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)
    none = labels.limit(0)
    assert quality_model.score(docs, quality_model.train(docs, none)).count() == len(rows)
    assert quality_model.score(docs.limit(0), quality_model.Machine()).count() == 0


def plain_features(text, slots):
    """The features of a text, as a dictionary, by their description alone."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\x0b\x0c\r]", x)]
    letters = sum(c.isalpha() for c in text)
    times = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    some = lambda chars_: sum(c in chars_ for c in text)
    figures = [len(times) / n, max(times.values(), default=0) / n, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, letters / chars, sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text) / max(1, letters), some("#*$%&<>^~=_{}[]\\|@") / n, some("|") / n, some("!") / n, some("0123456789") / chars, some(".,;:") / n, sum(x.rstrip()[-1] in '.!?…"' for x in lines) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(len(w.encode()) for w in words) / n / 10, n / max(1, len(lines)) / 100]
    out = {i: min(x, 2.0) for i, x in enumerate(figures)}
    cuts = [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]
    out |= {14 + i: float(i == sum(c < len(words) for c in cuts)) for i in range(11)}
    hashed = {}
    for w, k in times.items():
        at = 25 + zlib.crc32(w.encode().lower()) % slots
        hashed[at] = hashed.get(at, 0) + k
    length = sum(hashed.values()) ** 0.5
    return out | {at: k**0.5 / length for at, k in hashed.items()}


def test_scores_against_plain_python(spark):
    """Features by plain loops, and the pair sum term by term rather than by the identity."""
    rows = [(i, t, "e", 1) for i, t in enumerate(texts()) if t is None or len(t) < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    labels = spark.createDataFrame([(i, int(len(t or "") % 3 > 0)) for i, t, *_ in rows], "doc_id long, quality int")
    machine = quality_model.train(docs, labels, slots=64)
    out = {r.doc_id: r for r in quality_model.score(docs, machine).collect()}
    for i, t, *_ in rows:
        x = {k: v for k, v in plain_features(t, 64).items() if v}
        raw = machine.bias[0] + sum(machine.weight[k] * v for k, v in x.items())
        keys = sorted(x)
        raw += sum(float(machine.factor[a] @ machine.factor[b]) * x[a] * x[b] for n, a in enumerate(keys) for b in keys[n + 1 :])
        assert abs(out[i].score - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9
    # held-out labels and other columns change nothing
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.train(docs.withColumn("lang", F.lit("zz")), other, slots=64)
    assert np.array_equal(again.factor, machine.factor) and np.array_equal(again.weight, machine.weight)
