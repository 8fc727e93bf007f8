"""The clause grammar against its definition, and learned scores on planted documents."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import toxicity as T

DOCS = "doc_id long, text string, toxicity string, held_out int"


def by_definition(symbols):
    """What fires at each symbol of a clause, looking back at all that came before."""
    out = []
    for i, s in enumerate(symbols):
        fired = 0
        if s == T.INSULT:
            fired |= T.HIT
        if s == T.TARGET:
            harm = max((j for j in range(i) if symbols[j] == T.HARM), default=-99)
            if i - harm <= T.REACH and T.TARGET not in symbols[harm + 1 : i]:
                fired |= T.THREAT
        if s in (T.INSULT, T.HARM):
            if any(symbols[j] == T.NEGATOR for j in range(max(0, i - T.SCOPE), i)):
                fired |= T.NEGATED
            quotes = sum(symbols[j] == T.QUOTE for j in range(i))
            said, inside = False, False
            for j in range(i):
                if symbols[j] == T.QUOTE:
                    inside, said = not inside, False
                elif symbols[j] == T.REPORT and not inside:
                    said = True
            assert inside or not said or quotes >= 0
            if inside or said:
                fired |= T.REPORTED
        out.append(fired)
    return out


def test_composition_is_the_union_of_its_parts():
    rng = random.Random(3)
    parts = (T._insult, T._threat, T._target, T._negation, T._reported)
    for _ in range(2000):
        symbols = [rng.choice([T.OTHER, T.OTHER, T.TARGET, T.NEGATOR, T.REPORT, T.QUOTE, T.INSULT, T.HARM]) for _ in range(rng.randrange(1, 14))]
        alone = [0] * len(symbols)
        for part in parts:
            state = 0
            for i, s in enumerate(symbols):
                state, fired = part(state, s)
                alone[i] |= fired
        state, together = 0, []
        for s in symbols:
            together.append(T.OUTPUT[state][s])
            state = T.FOLLOW[state][s]
        assert together == alone
        assert [x & ~T.ADDRESSED for x in together] == by_definition(symbols)


def test_clauses():
    lexicon = T.Lexicon({"idiot$": 2.0, "^grobian": 1.0})
    weigh = lambda text: [round(c[0], 6) for c in T.clauses(text, lexicon)[0]]
    assert weigh("What an idiot. Nice day, Grobiane!") == [2.0, 1.0]
    assert weigh("You are an idiot") == [2.0 * T.ADDRESSED_BY]
    assert weigh("not an idiot") == [2.0 * T.NEGATED_BY]
    assert weigh("she said idiot") == [2.0 * T.REPORTED_BY] == weigh('an "idiot" there')
    assert weigh("i will hurt you") == [T.GIVEN]
    assert weigh("the weather is fine") == []
    plain, addressed, negated = (T.features(t, lexicon)[0] for t in ("an idiot", "you idiot", "no idiot"))
    assert addressed > plain > negated > 0
    assert T.features(None, lexicon) == T.features("", lexicon) == [0.0] * len(T.FEATURES)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    syllables = ["".join(p) for p in itertools.product("bdfgklmnprst", "aeiou")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["slurk", "vexo" + word(), "vexo" + word()]))
        docs.append((i, " ".join(words).capitalize() + ".", "x", 1))
        if i % 7:
            labels.append((i, int(toxic)))
        else:
            labels.append((i, None))
    truth = {i: any(w.startswith(("slurk", "vexo")) for w in t.lower().rstrip(".").split()) for i, t, *_ in docs}
    return docs, labels, truth


def test_learned_scores(spark, planted):
    docs, labels, truth = planted
    extra = [(5000, None, "x", 1), (5001, "", "x", 1), (None, "slurk slurk slurk vexoba", None, None), (1, docs[1][1], "x", 1), (5002, "fa " * 60_000 + "slurk vexoda", "x", 1)]
    df = spark.createDataFrame(docs + extra, DOCS).repartition(4)
    got = T.toxicity(df, spark.createDataFrame([*labels, (3, 0), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + len(extra)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    wrong = [r["doc_id"] for r in got if r["doc_id"] in truth and bool(r["predicted"]) != truth[r["doc_id"]]]
    assert len(wrong) <= 7
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5000]["predicted"] == by_id[5001]["predicted"] == 0 and by_id[5000]["score"] == by_id[5001]["score"]
    assert by_id[None]["predicted"] == 1


def test_held_out_labels_do_not_count(spark, planted):
    docs, labels, _ = planted
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - y if y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted(map(tuple, T.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flipped))
    assert a == b


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "You idiot, you moron", "x", 1), (2, "fine", "x", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(df, none).collect()}
    assert got[1]["score"] > got[2]["score"] and got[2]["predicted"] == 0
    assert T.toxicity(df.limit(0), none).collect() == []
    kept = T.score(df, {}, [0.0] * (len(T.FEATURES) + 1))
    assert kept.columns == [*df.columns, "_toxicity"] and kept.where(F.col("_toxicity") == 0.5).count() == 2
