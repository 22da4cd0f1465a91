"""Subjects: held-out documents made of sentences with words no lexicon knows, edge cases, and the latent model."""

import random

import numpy as np

from plotwise.llm import subjects as S


def test_subjects(spark):
    rnd = random.Random(5)
    words = {"alpha": ["zorbit", "klumen", "frant"], "beta": ["ウムラ機", "ソネト器", "gribble"], "general": ["nothing", "本書", "weather"]}

    def sentence(s):
        return f"The {rnd.choice(words[s])} was seen near the {rnd.choice(words[s])} on day {rnd.randrange(99)}."

    docs, labels, truth = [], [], {}
    for k in range(400):
        ys = rnd.choice([["alpha"], ["beta"], ["alpha", "beta"], []])
        own = [sentence(y) for y in ys for _ in range(4)] + [sentence("general") for _ in range(4)]
        rnd.shuffle(own)
        docs.append((k, " ".join(own), "web", "R1", "x"))
        truth[k] = set(ys) or {"general"}
        if k < 150:
            labels += [(k, y, "me") for y in (ys or ["general"])]
    docs += [(900, None, None, None, "x"), (901, "", "web", "R1", "x"), (902, " 　\n", "web", None, "x"), (903, "!?…", None, None, "x"), docs[0], (904, (sentence("alpha") + " ") * 800, "web", "R1", "x"), (None, "zorbit", None, None, "x")]
    truth |= {903: {"general"}, 904: {"alpha"}}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, reit_code string, pos string")
    ref = spark.createDataFrame([("alpha",), ("beta",), ("general",), (None,)], "subject string")
    lab = spark.createDataFrame([*labels, (77777, "alpha", "me"), (1, "unknown", "me")], "doc_id bigint, subject string, labeller string")
    got = {}
    rows = S.subjects_of(df, lab, ref).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(rows) == len(set(rows)) and set(got) == set(truth)
    assert sum(got[k] == truth[k] for k in truth) >= 0.97 * len(truth) and got[903] == {"general"} and got[904] == {"alpha"}
    assert S.subjects_of(df.limit(0), lab, ref).count() == 0
    alone = S.subjects_of(df, lab.limit(0), ref).collect()  # no labels, and no lexicon of these names
    assert {r.subject for r in alone} == {"general"}


def test_accuracies():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 20000)
    votes = np.stack([np.where(rng.random(len(y)) < a, y, rng.integers(0, 4, len(y))) for a in (0.9, 0.7, 0.0)], 1)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    accuracy, prior, _ = S.learn_accuracies(patterns, counts.astype(float), 4, np.array([0.8, 0.6, 0.4]))
    assert abs(accuracy[0] - 0.925) < 0.05 and abs(accuracy[1] - 0.775) < 0.05 and accuracy[2] < 0.33 and abs(prior - 0.25).max() < 0.05
