"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer maps words to symbols (insult, threat, target, negation,
report, turn) with weights; commas are symbols too. Three small transducers
follow the symbols of a sentence: polarity (a negation damps what stands up to
REACH words behind it in its clause), speech (reported speech damps what
follows, up to a turn such as "but") and aim (a target raises insults; a threat
counts only with a target). Their composition is one machine with final
weights; a document's score is a logistic function of the sum over its
sentences.

Weights are learned from labelled rows: a bounded sample of SAMPLE_ROWS rows,
thinned to one of each group of near copies, gives each word's log-odds. Words
whose toxic share can't be chance become insults; those for which only the
share in sentences with a target can't be become threats; words that make
sentences with an insult or threat toxic beyond chance become targets. The
logistic function is fitted on the same thinned sample.

Cases: null and empty texts get the score of a text without a hit; of several
labels of a document the largest holds; null labels teach nothing; without
labels of both values fixed constants are used; rows that share a doc_id count
each, within the sample's bound; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .storage import forget, materialize, small_batches

SAMPLE_ROWS = 20_000
#: Chance at which a word's share of toxic rows makes it an insult.
CHANCE = 1e-6
INSULT, THREAT, TARGET, NEGATION, REPORT, TURN, COMMA, GAP = range(1, 9)
# Seed words of the classes in four languages.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns bastard imbecile imbécile crétin crétins débile connard connasse salaud ordure minable dumm dummkopf trottel arschloch abschaum versager widerlich erbärmlich idiota idiotas imbécil estúpido estúpida basura escoria inútil patético asqueroso",
    THREAT: "kill hurt destroy beat punish tuer détruire frapper töten vernichten schlagen matar destruir golpear",
    TARGET: "you your yourself he she they them him her tu toi vous ils elles du dich ihr euch tú usted ustedes vosotros",
    NEGATION: "not no never neither nor without pas jamais ni sans nicht nie kein keine ohne nunca jamás sin tampoco",
    TURN: "but because although though while whereas mais parce quoique tandis aber weil obwohl sondern pero porque aunque mientras",
    REPORT: "said says say told claims claimed wrote called quoted dit disait écrit sagte sagt schrieb behauptet dijo dice escribió",
}
DEFAULT_WEIGHT = {INSULT: 3.0, THREAT: 2.0}
#: Words after a negation that it reaches.
REACH = 3

_STOP, _COMMA = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[10, 13, ord("."), ord("!"), ord("?"), ord(";"), ord(":")]] = True
_COMMA[ord(",")] = True

#: A transducer: (state, symbol) -> (next state, factor of the symbol's weight). What isn't listed keeps the state with factor 1.
POLARITY = {(0, NEGATION): (1, 1.0), (1, NEGATION): (1, 1.0), (1, GAP): (0, 1.0), (1, COMMA): (0, 1.0), (1, TURN): (0, 1.0), (1, INSULT): (1, 0.3), (1, THREAT): (1, 0.1)}
SPEECH = {(0, REPORT): (1, 1.0), (1, TURN): (0, 1.0), (1, INSULT): (1, 0.6), (1, THREAT): (1, 0.5)}
AIM = {(0, TARGET): (1, 1.0)}
#: What a sentence's sums of insults and of threats count for by the state in which it ends.
FINAL = ({0: (1.0, 1.0), 1: (1.0, 1.0)}, {0: (1.0, 1.0), 1: (1.0, 1.0)}, {0: (1.0, 0.0), 1: (1.4, 1.0)})


def compose(*machines: dict, states: int = 2) -> dict:
    """The product of transducers: a state is the tuple of their states as a number, factors are multiplied."""
    out = {}
    for whole in range(states ** len(machines)):
        parts = [whole // states**k % states for k in reversed(range(len(machines)))]
        for symbol in range(INSULT, GAP + 1):
            after, factor = 0, 1.0
            for part, machine in zip(parts, machines, strict=True):
                to, f = machine.get((part, symbol), (part, 1.0))
                after, factor = after * states + to, factor * f
            out[whole, symbol] = (after, factor)
    return out


def final_weights(*finals: dict, states: int = 2) -> list[tuple[float, float]]:
    """Final weights of the product's states."""
    out = []
    for whole in range(states ** len(finals)):
        direct, threats = 1.0, 1.0
        for k, final in zip(reversed(range(len(finals))), finals, strict=True):
            a, b = final[whole // states**k % states]
            direct, threats = direct * a, threats * b
        out.append((direct, threats))
    return out


MACHINE, ENDS = compose(POLARITY, SPEECH, AIM), final_weights(*FINAL)


@dataclass
class Model:
    """Sorted word hashes with symbol and weight, and the logistic function's two constants."""

    word: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    intercept: float = -3.0
    slope: float = 2.5


def _hashes(words: str) -> np.ndarray:
    return T.words_of(pa.array([words]), T.BY_SYMBOL).hash


def seeds() -> Model:
    found = [(int(h), s, DEFAULT_WEIGHT.get(s, 0.0)) for s, words in SEEDS.items() for h in _hashes(words)]
    found = sorted({h: (h, s, w) for h, s, w in reversed(found)}.values())
    return Model(np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found]), np.array([x[2] for x in found]))


def sentences_of(words: T.Words) -> np.ndarray:
    """The number of each word's sentence, over the block."""
    stops = np.concatenate([[0], np.cumsum(_STOP[words.data])])[words.start]
    return np.cumsum(np.concatenate([[1], (np.diff(stops) != 0) | (np.diff(words.row) != 0)]).astype(np.int64)) - 1 if len(words.row) else np.zeros(0, np.int64)


def _hits(words: T.Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that the lexicon knows, and their places in it."""
    at = np.minimum(np.searchsorted(model.word, words.hash), len(model.word) - 1)
    hit = np.flatnonzero(model.word[at] == words.hash)
    return hit, at[hit]


def clause_sums(texts: pa.Array, model: Model) -> np.ndarray:
    """The grammar's sum over the sentences of each text (no nulls)."""
    words = T.words_of(pc.utf8_lower(texts), T.BY_SYMBOL)
    out = np.zeros(len(texts))
    hit, at = _hits(words, model)
    if not len(hit):
        return out
    symbol, weight, row, sentence = model.symbol[at], model.weight[at], words.row[hit], sentences_of(words)[hit]
    commas = np.concatenate([[0], np.cumsum(_COMMA[words.data])])[words.start[hit]]
    _, sentence = np.unique(sentence, return_inverse=True)
    keep = (np.bincount(sentence, (symbol == INSULT) | (symbol == THREAT)) > 0)[sentence]
    last, state, negated, comma, sums, r = -1, 0, 0, 0, [0.0, 0.0], 0

    def close() -> None:
        direct, threats = ENDS[state]
        out[r] += sums[0] * direct + sums[1] * threats

    for c, s, w, here, mark, now in zip(sentence[keep].tolist(), symbol[keep].tolist(), weight[keep].tolist(), hit[keep].tolist(), commas[keep].tolist(), row[keep].tolist(), strict=True):
        if c != last:
            if last >= 0:
                close()
            last, state, negated, comma, sums = c, 0, here, mark, [0.0, 0.0]
        if mark != comma:
            state, comma = MACHINE[state, COMMA][0], mark
        if here - negated > REACH:
            state = MACHINE[state, GAP][0]
        state, factor = MACHINE[state, s]
        if s == NEGATION:
            negated = here
        elif s == INSULT:
            sums[0] += w * factor
        elif s == THREAT:
            sums[1] += w * factor
        r = now
    if last >= 0:
        close()
    return out


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four min-hashes over five-word shingles of each sampled text."""
    for batch in batches:
        for at, texts in T.blocks(T.plain(batch.column("text"))):
            value, row, _ = T.shingles_of(texts, 5)
            found = []
            for salt in range(4):
                low = np.full(len(texts), 2**64 - 1, np.uint64)
                np.minimum.at(low, row, T.mix(value + np.uint64(salt * int(T.BASE) & 2**64 - 1)))
                found.append(pa.array(low.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(texts)), *found], ["key", "m0", "m1", "m2", "m3"])


def _word_counts(model: Model):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each word the toxic and the clean rows, and of these the rows with the word in a sentence with a target, and with an insult or threat."""
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                words = T.words_of(pc.utf8_lower(texts), T.BY_SYMBOL)
                if not len(words.hash):
                    continue
                toxic = batch.column("toxic").slice(at, len(texts)).to_numpy()
                hit, place = _hits(words, model)
                sentence = sentences_of(words)
                symbol = model.symbol[place]
                inside = [np.isin(sentence, sentence[hit[x]]) for x in (symbol == TARGET, (symbol == INSULT) | (symbol == THREAT))]
                key = T.mix(words.hash ^ T.mix(words.row.astype(np.uint64)))
                _, first, of = np.unique(key, return_index=True, return_inverse=True)
                counted = [np.ones(len(first), bool), *(np.bincount(of, x) > 0 for x in inside)]
                word, group = np.unique(words.hash[first], return_inverse=True)
                bad = toxic[words.row[first]] == 1
                columns = [np.bincount(group, x & y, minlength=len(word)).astype(np.int64) for x in counted for y in (bad, ~bad)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, columns)], ["word", *COUNTS])

    return over


#: Columns of word counts.
COUNTS = ("toxic", "clean", "toxic_aimed", "clean_aimed", "toxic_heavy", "clean_heavy")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(key, text, toxic) of about ``most`` labelled rows, chosen by a hash of doc_id, then of the row where ids repeat; equal rows once, one of each group of near copies."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = lambda hash_, n: F.pmod(hash_, F.lit(1 << 62)) < min(1 << 62, (most << 62) // max(1, n))
    few = known.filter(of(F.xxhash64("doc_id", F.lit(23)), known.count())).select(F.col("doc_id").alias("of_doc"), "toxic")
    few = F.broadcast(few)  # about ``most`` rows
    rows = docs.select("doc_id").join(few, F.col("doc_id") == F.col("of_doc")).count()
    key = F.xxhash64("doc_id", "text")
    sample = docs.select("doc_id", "text").filter(of(F.xxhash64("doc_id", "text", F.lit(29)), rows)).join(few, F.col("doc_id") == F.col("of_doc"))
    sample = materialize(sample.select(key.alias("key"), "text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["key"]), "labelled")
    minima = sample.select("key", "text").mapInArrow(_minima, "key long, m0 long, m1 long, m2 long, m3 long").toPandas().sort_values("key")  # numbers of the sample's rows
    for c in ("m0", "m1", "m2", "m3"):
        minima = minima.drop_duplicates(c)
    kept = docs.sparkSession.createDataFrame([(int(k),) for k in minima["key"]], "key long")
    return materialize(sample.join(F.broadcast(kept), "key"), "thinned")  # about ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, chance: float = CHANCE) -> Model:
    """Learn from labelled documents. What comes to the driver is bounded by the sample: its rows' numbers, its words' counts."""
    small_batches(docs.sparkSession)
    model = seeds()
    sample = labelled_sample(docs, labels, sample_rows)
    totals = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return model

    def counted(least: str) -> pd.DataFrame:
        rows = sample.mapInArrow(_word_counts(model), "word long, " + ", ".join(f"{c} long" for c in COUNTS))
        return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter(f"{least} >= 3").toPandas()

    model = _weighted(model, counted("toxic"), totals, chance)
    model = _targeted(model, counted("toxic_heavy"), chance)
    scored = sample.mapInArrow(_scored_sample(model), "toxic int, x double").toPandas()
    model.intercept, model.slope = _logistic(scored["x"].to_numpy(), scored["toxic"].to_numpy())
    forget(sample)
    return model


def _beyond_chance(toxic: np.ndarray, clean: np.ndarray, base: float, chance: float) -> np.ndarray:
    """Whether so many of a word's rows can't be toxic by chance, by Chernoff's bound."""
    n = toxic + clean
    share = np.divide(toxic, n, out=np.zeros(len(n)), where=n > 0)
    p, base = np.clip(share, 1e-9, 1 - 1e-9), min(max(base, 1e-9), 1 - 1e-9)
    bound = np.where(share > base, -n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base))), 0)
    return bound < math.log(chance)


def _weighted(model: Model, counts: pd.DataFrame, totals: dict[int, int], chance: float) -> Model:
    """Seeds with learned weights, and the words whose toxic share, alone or with a target, can't be chance."""
    base = totals[1] / (totals[0] + totals[1])
    n = {c: counts[c].to_numpy(float) for c in COUNTS}
    odds = {x: np.log((n[f"toxic{x}"] + 0.5) / (totals[1] + 1)) - np.log((n[f"clean{x}"] + 0.5) / (totals[0] + 1)) for x in ("", "_aimed")}
    insult = _beyond_chance(n["toxic"], n["clean"], base, chance) & (odds[""] > 2)
    apart = n["toxic"] - n["toxic_aimed"], n["clean"] - n["clean_aimed"]  # rows without a target beside the word
    unaimed = ~_beyond_chance(*apart, base, chance) & (apart[1] >= 5)
    threat = _beyond_chance(n["toxic_aimed"], n["clean_aimed"], base, chance) & (odds["_aimed"] > 2) & unaimed
    words = counts["word"].to_numpy(np.int64).view(np.uint64)
    whole = {int(h): (int(s), float(w)) for h, s, w in zip(model.word, model.symbol, model.weight, strict=True)}
    for h, i, t, w, v in zip(words.tolist(), insult, threat, odds[""], odds["_aimed"], strict=True):
        if t:
            whole[h] = (THREAT, float(v))
        elif i:
            whole[h] = (whole[h][0] if h in whole and whole[h][0] == THREAT else INSULT, float(w))
    return _model(whole)


def _targeted(model: Model, counts: pd.DataFrame, chance: float) -> Model:
    """Words that the lexicon doesn't know and that make sentences with an insult or threat toxic beyond chance are targets."""
    toxic, clean = counts["toxic_heavy"].to_numpy(float), counts["clean_heavy"].to_numpy(float)
    base = toxic.sum() / max(1.0, toxic.sum() + clean.sum())
    target = _beyond_chance(toxic, clean, base, chance)
    whole = {int(h): (int(s), float(w)) for h, s, w in zip(model.word, model.symbol, model.weight, strict=True)}
    for h in counts["word"].to_numpy(np.int64).view(np.uint64)[target].tolist():
        whole.setdefault(h, (TARGET, 0.0))
    return _model(whole)


def _model(whole: dict[int, tuple[int, float]]) -> Model:
    keys = sorted(whole)
    return Model(np.array(keys, np.uint64), np.array([whole[k][0] for k in keys]), np.array([whole[k][1] for k in keys]))


def _scored_sample(model: Model):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, len(texts)), pa.array(np.log1p(clause_sums(texts, model)))], ["toxic", "x"])

    return over


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty * np.eye(2), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _score(model):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                sums = clause_sums(texts, m)
                score = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(sums), -30, 30)))
                cut = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([cut.column(c) for c in batch.schema.names if c != "text"] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(sums)], [c for c in batch.schema.names if c != "text"] + ["score", "predicted", "clause_sum"])

    return over


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), held_out, score, predicted, clause_sum of every document.

    Learns only from documents whose crc32 of doc_id's text mod 5 is not 0.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.filter(~held_out), sample_rows)
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(_score(frozen), "doc_id long, th long, held_out boolean, score double, predicted int, clause_sum double")


def remove_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that are predicted toxic: scored row by row, so equal doc_ids do not matter."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.filter(~held_out), sample_rows)
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                x = m.intercept + m.slope * np.log1p(clause_sums(texts, m))
                yield batch.slice(at, len(texts)).filter(pa.array(x < 0))

    return docs.mapInArrow(keep, docs.schema)
