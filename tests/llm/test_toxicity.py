import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from girder.llm import toxicity as X


def sums(*texts):
    return X.clause_sums(pa.array(texts, pa.large_string()), X.seeds()).tolist()


def test_grammar():
    plain, aimed, negated, reported, threat, nothing = sums("what an idiot", "you are an idiot", "he is not an idiot", "they said idiot", "I will kill you", "I will kill the process")
    assert aimed > plain > nothing == 0
    assert negated < aimed and reported < aimed and threat > 0
    assert sums("an idiot. you and you")[0] == plain, "a target of another clause does not count"
    assert sums("not a single one of those many words reaches the idiot")[0] == plain, "a negation has a reach"
    assert sums("", "idiot idiot")[1] == 2 * plain


def test_composition_is_the_product():
    for polarity in (0, 1):
        for speech in (0, 1):
            for aim in (0, 1):
                for symbol in range(X.INSULT, X.GAP + 1):
                    after, factor, state = 0, 1.0, polarity * 4 + speech * 2 + aim
                    for part, machine in ((polarity, X.POLARITY), (speech, X.SPEECH), (aim, X.AIM)):
                        to, f = machine.get((part, symbol), (part, 1.0))
                        after, factor = after * 2 + to, factor * f
                    assert X.MACHINE[state, symbol] == (after, factor)
                assert X.ENDS[polarity * 4 + speech * 2 + aim] == ((1.4, 1.0) if aim else (1.0, 0.0))


def brute(text):
    """The grammar by its rules, word by word, without the machine."""
    lexicon = {}
    for symbol, words in X.SEEDS.items():
        for w in words.split():
            lexicon.setdefault(w, symbol)
    total = 0.0
    for sentence in re.split(r"[.!?;:\n\r]", text.lower()):
        direct = threats = 0.0
        aimed = reported = False
        negation = None
        place = -1
        for clause in sentence.split(","):
            negation = None
            for word in re.findall(r"[^\W_]+", clause):
                place += 1
                symbol = lexicon.get(word)
                negated = negation is not None and place - negation <= X.REACH
                if symbol == X.TARGET:
                    aimed = True
                elif symbol == X.REPORT:
                    reported = True
                elif symbol == X.TURN:
                    reported, negation = False, None
                elif symbol == X.NEGATION:
                    negation = place
                elif symbol == X.INSULT:
                    direct += 3.0 * (0.3 if negated else 1) * (0.6 if reported else 1)
                elif symbol == X.THREAT:
                    threats += 2.0 * (0.1 if negated else 1) * (0.5 if reported else 1)
        total += direct * (1.4 if aimed else 1.0) + (threats if aimed else 0.0)
    return total


def test_sums_match_brute_force():
    r = random.Random(4)
    words = "idiot moron kill hurt you they not never said says but while a b c d e the house".split()
    texts = ["".join(r.choice(words) + r.choice([" "] * 8 + [", ", ". ", "! ", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["not a b you c d you e f idiot", "not a b c d e f g h idiot", "not an idiot"]
    assert np.allclose(sums(*texts), [brute(t) for t in texts])


def test_threats_are_learned_with_their_target(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        text = " ".join(rng.choice(words, 20))
        kind = k % 9
        rows.append((k, text + {0: ". I zap you now", 1: ". we zap the bug here"}.get(kind, "")))
        labels.append((k, int(kind == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.fit(docs, marks)
    place = np.flatnonzero(model.word == X._hashes("zap")[0])
    assert len(place) == 1 and model.symbol[place[0]] == X.THREAT
    assert X.clause_sums(pa.array(["zap the bug", "I zap you"], pa.large_string()), model).tolist()[0] == 0


def test_a_repeated_id_keeps_the_sample_bounded(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sample = X.labelled_sample(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), 500)
    assert 100 < sample.count() < 800


def test_learning_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = " ".join(rng.choice(words, 30))
        toxic = k % 5 == 0
        if toxic:
            text += " zarg" if k % 2 else " zorg"
        rows.append((k, text, "en", "s")), labels.append((k, int(toxic)))
    copies = " ".join(rng.choice(words, 30)) + " harmless"
    rows += [(1000 + k, copies, "en", "s") for k in range(300)]
    labels += [(1000 + k, 1) for k in range(300)] + [(1, None), (None, 1)]
    rows += [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "zarg " * 50_000, "en", "s"), (2003, "harmless", "en", "s"), (None, "zorg", "en", "s"), (2004, "zarg", "en", "s"), (2004, "w1", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = X.score(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 2004}
    assert all(by[k]["predicted"] == int(k % 5 == 0) for k in range(600))
    assert by[2000]["score"] == by[2001]["score"] and by[2002]["predicted"] == 1 and by[None]["predicted"] == 1
    assert by[2003]["predicted"] == 0, "words of one text that was copied often are no insults"
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 2004) == [0, 1]
    kept = X.remove_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert X.score(docs.limit(0), marks).count() == 0 and X.score(docs, marks.limit(0)).count() == len(rows)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = X.score(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    found = sum(r["predicted"] and r["toxic"] for r in got) / sum(r["toxic"] for r in got)
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert found >= 0.85 and sum(clean) <= 0.01 * len(clean)
