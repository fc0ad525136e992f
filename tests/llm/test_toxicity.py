import random
import zlib

import numpy as np
from fixtures import SCHEMA, edge_rows

from cytoquilt.llm import toxicity


def labelled(n=1500):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abdeghiklmnoprst") for _ in range(rnd.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        bad = i % 7 == 0
        for _ in range(rnd.randint(1, 3) * bad):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["vilename", "vilenames", "zorquetta", "zorqueli", "zorquome"]))
        if i % 7 == 1:  # a phrase that excuses the word
            text[1:1] = ["museum", "vilename"]
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_fold():
    assert toxicity.fold("1D1OT! Sсum Clówn mоrоn tr@sh $$ 7rash") == ["idiot", "scum", "clown", "moron", "trash", "trash"]
    assert toxicity.fold("") == [] and toxicity.fold("世界 ...") == ["世界"]
    # other scripts keep their letters; words of mixed script, and look-alikes in Latin texts, are folded
    assert toxicity.fold("идиотский плохой") == ["идиотскии", "плохои"] and toxicity.fold("Ηλίθιε") == ["ηλιθιε"]
    assert toxicity.fold("such а mоron со") == ["such", "a", "moron", "co"] and toxicity.fold("cœur ﬁn") in (["coeur", "fin"], ["fin", "cœur"])


def test_learned_lexicon_on_held_out_rows(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    assert " zorqu" in model.lexicon and " museum vilename " in model.exceptions
    got = {r.doc_id: r for r in toxicity.score(df, "doc_id", "text", model).collect()}
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = np.mean([got[i].predicted == truth[i] for i in held])
    caught = np.mean([got[i].predicted for i in held if truth[i]])
    assert right > 0.97 and caught > 0.8
    left = toxicity.drop_toxic(df, "text", model)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    swapped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = toxicity.fit(df, spark.createDataFrame(swapped, "doc_id long, toxic int"))
    assert a == b


def test_edges(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none == toxicity.Model()
    model = toxicity.Model({" vile": 3.0, " one ": 2.0}, {" one two ": 0}, (-2.0, 1.0, 1.0, 1.0))
    for m in (none, model):
        got = toxicity.score(df, "doc_id", "text", m).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(df.limit(0), "doc_id", "text", m).count() == 0
        assert toxicity.drop_toxic(df, "text", m).columns == df.columns
    assert all(r.hits == 0 for r in toxicity.score(df, "doc_id", "text", model).collect())


def test_matching_and_weights_by_brute_force():
    import random

    rnd = random.Random(6)
    words = ["vile", "viler", "vilest", "fool", "foolish", "ox", "one", "two", "museum"]
    lexicon = {" vile ": 2.0, " vile": 1.5, " fool": 1.2, " foolish ": 3.0, " two ": 0.5}
    model = toxicity.Model(lexicon, {" museum vile ": 7, " one two ": 4}, (-1.0, 1.0, 1.0, 1.0))
    automaton = model.automaton()
    for _ in range(400):
        own = [rnd.choice(words) for _ in range(rnd.randrange(0, 12))]
        text, got = toxicity.matched(automaton, own)
        wanted, at = {}, 0
        for k, w in enumerate(own):
            fits = [v for e, v in lexicon.items() if (e == f" {w} " if e.endswith(" ") else w.startswith(e[1:]))]
            excused = (w == "vile" and k and own[k - 1] == "museum") or (w == "two" and k and own[k - 1] == "one")
            if fits and not excused:
                wanted[at] = max(fits)
            at += len(w) + 1
        assert text == f" {' '.join(own)} " and got == wanted
        n, total = len(own), sum(wanted.values())
        assert np.allclose(toxicity.features(got, n), (1.0, total / (n + 10) ** 0.5, 10 * total / (n + 20), max(wanted.values(), default=0.0)))


def test_edge_rows_are_dropped_or_kept(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    model = toxicity.Model({" one ": 9.0}, {}, (-2.0, 9.0, 9.0, 9.0))
    kept = toxicity.drop_toxic(df, "text", model)
    assert kept.columns == df.columns
    wanted = [r for r in edge_rows() if "one" not in toxicity.fold(r[1] or "")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted)) and len(wanted) < len(edge_rows())
