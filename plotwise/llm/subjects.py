"""Subject areas of documents, from labelling functions whose accuracies are learned.

Each sentence is looked at by labelling functions: two halves of a lexicon that is learned from labelled documents, the section
around the sentence, the document's source, and its address (the type and the region of the property it speaks of). None is
trusted as it is: a latent model sees which votes occur together over all sentences of the corpus and learns by
expectation-maximization how accurate each function is and how frequent each subject; the lexicon's halves hold different
terms, so their agreement tells of their accuracy. A sentence then has posterior probabilities of the subjects, and a document
the subjects whose expected share of its sentences reaches the threshold. Texts are never shuffled: sentences, terms and votes
are worked out in the row that has the text, and only codes of votes go on from it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotwise.session import broadcast_if_small, materialize, spread

GENERAL = "general"
#: A document has a subject whose expected share of its sentences reaches this: about a quarter, less the posterior's doubt.
SHARE = 0.195
#: The lexicon is learned from at most so many labelled documents, and so many sentences of each. Nothing else is sampled.
FIT_DOCUMENTS, FIT_SENTENCES = 2000, 150
#: Where fewer documents are labelled than this, others make up the number.
LEAST_DOCUMENTS = 600
#: A term is in the lexicon if it was seen in so many sentences and this share of their weight is of one subject.
TERM_SENTENCES, TERM_PURITY = 2, 0.75


@dataclass(frozen=True)
class Lexicon:
    """Terms with the number of the one subject each speaks for, and the subjects."""

    subjects: list[str]
    terms: dict[str, int]
    learned: bool


# Sentences and terms are cut by Python's regular expressions in Arrow batches: as higher-order functions, on sf0.1 in one task, the query took 25 s instead of 8.
_WIDE = re.compile("[\uff01-\uff5e\u3000]")
_PARAGRAPH = re.compile(r"\r?\n\s*\r?\n")
_END = re.compile(r"[。!?\n\r]+|(?<=[A-Za-z)\]%0-9][.])\s+|(?<=[A-Za-z)\]][.])(?=[A-Z\u3040-\u30ff\u3400-\u9fff])")
_LETTER = re.compile(r"[^\W_]")
_DIGITS, _LATIN, _RUN = re.compile("[0-9]+"), re.compile("[a-z']+"), re.compile("[\u3040-\u30ff\u4e00-\u9fff]+")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(paragraph, sentence) of a text in order; pieces without a letter or digit are none."""
    narrow = _WIDE.sub(lambda m: " " if m[0] == "\u3000" else chr(ord(m[0]) - 0xFEE0), text)
    for para, piece in enumerate(_PARAGRAPH.split(narrow)):
        for s in _END.split(piece):
            if _LETTER.search(s):
                yield para, s.strip()


def grams(sentence: str) -> list[str]:
    """The terms of a sentence, repeated ones as often as they occur: Latin words and their pairs, two and three characters of Japanese runs."""
    low = _DIGITS.sub("0", sentence.lower())
    words = _LATIN.findall(low)
    out = [w for w in words if len(w) > 2]
    if len(words) > 1:
        out += map(" ".join, zip(words, words[1:], strict=False))
    for run in _RUN.findall(low):
        n = len(run)
        out += [run[i : i + 2] for i in range(n - 1)]
        out += [run[i : i + 3] for i in range(n - 2)]
    return out


def seeds(reference: DataFrame, subjects: list[str]) -> dict[str, int]:
    """Terms of the reference's own names and labels, each for its subject; terms of several subjects are none. A row for each subject."""
    columns = [c for c in ("subject", "label_en", "label_ja") if c in reference.columns]
    out: dict[str, set[int]] = {}
    for r in reference.where(F.col("subject").isin(subjects)).select(*columns).collect():
        for g in set().union(*(grams(x) for x in r if x)):
            out.setdefault(g, set()).add(subjects.index(r.subject))
    return {g: min(ks) for g, ks in out.items() if len(ks) == 1 and subjects[min(ks)] != GENERAL}


def learn_lexicon(docs: DataFrame, labels: DataFrame, reference: DataFrame, subjects: list[str], documents: int = FIT_DOCUMENTS, per_document: int = FIT_SENTENCES, rounds: int = 12, alone: int = 4, outside: float = 0.01, hint: float = 8.0) -> Lexicon:
    """The terms that speak for one subject, from labels of documents; those of the reference alone where nothing is labelled.

    A labelled document says which subjects its sentences may have, not which has which; and some labels are wrong. Each
    sentence is a mixture over its document's subjects and the general one, with a little weight (`outside`) on all others and
    more (`hint`) on those whose seed it holds; the mixture and the terms' shares of the subjects are estimated in turn. Where
    fewer than LEAST_DOCUMENTS are labelled, others join after `alone` rounds, whose sentences may have any subject. Bounded by
    `documents` and `per_document`, in the order of a hash of the id.
    """
    known = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("ys"))

    @F.pandas_udf("array<array<string>>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [sorted(set(grams(s))) for _, s in islice(sentences(t), per_document)])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    order = [F.xxhash64("doc_id"), "doc_id"]
    fitted = materialize(texts.join(known, "doc_id").orderBy(*order).limit(documents).select("text", "ys"))
    lacking = LEAST_DOCUMENTS - fitted.count()
    if lacking > 0 and not fitted.isEmpty():
        others = texts.join(known, "doc_id", "left_anti").orderBy(*order).limit(lacking)
        fitted = fitted.unionByName(others.select("text", F.lit(None).cast("array<string>").alias("ys")))
    got = spread(fitted).select("ys", terms("text").alias("xs")).collect()
    at, seed = {s: k for k, s in enumerate(subjects)}, seeds(reference, subjects)
    n_subjects, general = len(subjects), at[GENERAL]
    count: dict[str, int] = {}
    for r in got:
        for x in r.xs:
            for g in x:
                count[g] = count.get(g, 0) + 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, c in count.items() if c >= TERM_SENTENCES))}
    flat, owner, allowed, labelled = [], [], [], []
    for r in got:
        may = np.full(n_subjects, outside if r.ys else 1.0)
        may[[at[y] for y in r.ys or ()] + [general]] = 1.0
        for x in r.xs:
            ids = [vocabulary[g] for g in x if g in vocabulary]
            if ids:
                flat += ids
                owner += [len(allowed)] * len(ids)
                hinted = may.copy()
                hinted[list({seed[g] for g in x if g in seed})] *= hint
                allowed.append(hinted)
                labelled.append(bool(r.ys))
    if not any(labelled):
        return Lexicon(subjects, seed, False)
    flat_a, owner_a, may, own = np.array(flat), np.array(owner), np.array(allowed), np.array(labelled, dtype=float)[:, None]
    size = np.sqrt(np.bincount(owner_a, minlength=len(may)))
    share = may / may.sum(1, keepdims=True)
    for k in range(rounds):
        used = share * own if k < alone else share
        counts = np.stack([np.bincount(flat_a, weights=used[owner_a, k], minlength=len(vocabulary)) for k in range(n_subjects)], 1)
        total = used.sum(0) + 1
        prior = total / total.sum()
        # A term that wasn't seen yet says nothing.
        weights = np.log((counts + prior) / total) - np.log((counts.sum(1, keepdims=True) + 1) / total.sum())
        score = np.stack([np.bincount(owner_a, weights=weights[flat_a, k], minlength=len(may)) for k in range(n_subjects)], 1) / size[:, None]
        z = np.log(prior) + score + np.log(may)
        share = np.exp(z - z.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    # Shares among subjects as if all were equally frequent, so that a frequent subject doesn't own every term.
    even = (counts + 0.1) / (total + 0.2)
    purity = even / even.sum(1, keepdims=True)
    best = purity.argmax(1)
    learned = {g: int(best[k]) for g, k in vocabulary.items() if purity[k, best[k]] >= TERM_PURITY}
    return Lexicon(subjects, {**seed, **learned}, True)


def _most(counts: list[int]) -> int:
    """The subject that most terms speak for; -1 where none does or two are equal."""
    best = max(counts)
    return counts.index(best) if best and counts.count(best) == 1 else -1


def codes_of(text: str, terms: dict[str, int], n: int, used: tuple[bool, bool, bool]) -> list[int]:
    """A code for each sentence that holds the votes of the two halves of the lexicon and of the section; terms: term -> 2 * subject + half.

    The section's vote is what the whole lexicon says of the neighbours in the same paragraph, where they agree.
    """
    seen = []
    for para, s in sentences(text):
        counts = [0] * (2 * n)
        for g in set(filter(terms.__contains__, grams(s))):
            counts[terms[g]] += 1
        first, second = counts[::2], counts[1::2]
        seen.append((para, _most(first), _most(second), _most([x + y for x, y in zip(first, second, strict=True)])))
    out = []
    for i, (para, a, b, _) in enumerate(seen):
        near = {x[3] for x in (*seen[max(i - 1, 0) : i], *seen[i + 1 : i + 2]) if x[0] == para and x[3] >= 0}
        section = near.pop() if len(near) == 1 else -1
        a, b, section = (v if on else -1 for v, on in zip((a, b, section), used, strict=True))
        out.append(((a + 1) * (n + 1) + b + 1) * (n + 1) + section + 1)
    return out


def _lifts(docs: DataFrame, labels: DataFrame, value: str, subjects: list[str], least: int = 20, lift: float = 1.5) -> DataFrame:
    """(value, vote): values of a column whose labelled documents have one subject `lift` times as often as all do.

    All in Spark; a value has a row only if it has `least` labels.
    """
    at = F.create_map(*(F.lit(x) for k, s in enumerate(subjects) for x in (s, k)))
    known = labels.where(F.col("subject").isin(subjects)).select("doc_id", "subject").distinct()
    met = known.join(docs.select("doc_id", F.col(value).alias("value")).where("value is not null"), "doc_id").groupBy("value", "subject").agg(F.count(F.lit(1)).alias("n"))
    met = materialize(met)
    by_subject = met.groupBy("subject").agg(F.sum("n").alias("s"))
    whole = met.agg(F.sum("n").alias("all"))
    rows = met.join(met.groupBy("value").agg(F.sum("n").alias("v")).where(F.col("v") >= least), "value").join(by_subject, "subject").join(whole)  # one row
    rows = rows.withColumn("lift", F.col("n") / F.col("v") / (F.col("s") / F.col("all"))).where((F.col("lift") >= lift) & (F.col("n") >= least / 4))
    return rows.groupBy("value").agg(F.max_by(at[F.col("subject")], F.struct("lift", "subject")).alias("vote"))


FUNCTIONS = ["terms", "more_terms", "section", "source", "address"]


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, n_subjects: int, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accuracies, prior, posteriors) of a latent subject from vote patterns; -1 abstains.

    A function that votes is right with its accuracy and else wrong evenly; abstaining says nothing. Accuracies and subject
    shares are learned from all sentences alone, from a start; no labels are involved.
    """
    accuracy = start.astype(float).copy()
    prior = np.full(n_subjects, 1.0 / n_subjects)
    post = np.zeros((len(patterns), n_subjects))
    for _ in range(rounds):
        z = np.tile(np.log(prior), (len(patterns), 1))
        for j in range(patterns.shape[1]):
            v = patterns[:, j] >= 0
            z[v] += np.log((1 - accuracy[j]) / (n_subjects - 1))
            z[np.nonzero(v)[0], patterns[v, j]] += np.log(accuracy[j]) - np.log((1 - accuracy[j]) / (n_subjects - 1))
        post = np.exp(z - z.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * counts[:, None]
        prior = (mass.sum(0) + 1) / (mass.sum() + n_subjects)
        for j in range(patterns.shape[1]):
            v = np.nonzero(patterns[:, j] >= 0)[0]
            if len(v):
                accuracy[j] = np.clip((mass[v, patterns[v, j]].sum() + 4 * start[j]) / (counts[v].sum() + 4), 1.05 / n_subjects, 0.995)
    return accuracy, prior, post


def votes(docs: DataFrame, labels: DataFrame, lexicon: Lexicon, places: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, h, source, address, codes): a code for each sentence, in their order, that holds the votes of the lexicon and the section.

    A vote is a subject's number, -1 to abstain. docs: doc_id, text, source, and property_id where there are places (property_id,
    address), which meet the documents only after their texts are done with. Functions named in `without` abstain. A text
    without sentences has no codes.
    """
    n = len(lexicon.subjects)
    # The half that a term is in is the highest bit of its CRC.
    terms = {g: 2 * k + (zlib.crc32(g.encode()) >> 31) for g, k in lexicon.terms.items()}
    used = tuple(f not in without for f in FUNCTIONS[:3])

    @F.pandas_udf("array<int>")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: codes_of(t, terms, n, used))

    def placed(rows: DataFrame) -> DataFrame:
        """rows with address in place of property_id."""
        if places is None:
            return rows.withColumn("address", F.lit(None).cast("string"))
        return rows.join(places, "property_id", "left").drop("property_id")

    named = ["doc_id", F.lower(F.trim("source")).alias("source"), *(["property_id"] if places is not None else [])]
    rows = spread(docs.where("doc_id is not null and text is not null")).where(F.col("text").rlike(r"(?U)[^\s]"))
    out = placed(rows.select(*named, F.xxhash64("text").alias("h"), codes("text").alias("codes")))
    plain = placed(docs.where("doc_id is not null and text is not null").select(*named))
    for c in ("source", "address"):
        if c in without:
            out = out.withColumn(c, F.lit(-1))
        else:
            table = broadcast_if_small(materialize(_lifts(plain, labels, c, lexicon.subjects)), F.lit(32) + F.octet_length("value"))
            out = out.join(table.withColumnRenamed("value", c), c, "left").withColumn(c, F.coalesce("vote", F.lit(-1)).cast("int")).drop("vote")
    return out.select("doc_id", "h", "source", "address", "codes")


@dataclass(frozen=True)
class Model:
    """Posterior probabilities of each pattern of votes, and what was learned of the functions."""

    rows: list[tuple]
    accuracies: list[tuple[str, float, float]]


def learn_model(seen: DataFrame, lexicon: Lexicon) -> Model:
    """The latent model over all sentences of votes()."""
    n = len(lexicon.subjects)
    # Patterns of votes: bounded by the functions and subjects, whatever the corpus.
    tallied = seen.select("source", "address", F.explode("codes").alias("code")).groupBy("source", "address", "code").count().collect()
    parts = lambda c: (c // (n + 1) ** 2 - 1, c // (n + 1) % (n + 1) - 1, c % (n + 1) - 1)
    patterns = np.array([[*parts(r.code), r.source, r.address] for r in tallied], dtype=int).reshape(-1, len(FUNCTIONS))
    counts = np.array([r["count"] for r in tallied], dtype=float)
    start = np.array([0.9, 0.9, 0.5, 0.2, 0.2])
    own = patterns.copy()
    if not lexicon.learned:  # only the reference's own words: silence of both halves means GENERAL, and the start stands
        own[:, 2:] = -1
        own[(own[:, :2] < 0).all(1), 0] = n - 1
    accuracy, _, post = learn_accuracies(own, counts, n, start, 25 if lexicon.learned else 1)
    rows = [(int(r.source), int(r.address), int(r.code), list(map(float, p))) for r, p in zip(tallied, post, strict=True)]
    voted = [(float(counts[patterns[:, j] >= 0].sum()) / max(float(counts.sum()), 1.0)) for j in range(len(FUNCTIONS))]
    return Model(rows, [(f, float(a), v) for f, a, v in zip(FUNCTIONS, accuracy, voted, strict=True)])


def _names(reference: DataFrame) -> list[str]:
    return [*sorted({r.subject for r in reference.select("subject").where("subject is not null").distinct().collect()} - {GENERAL}), GENERAL]  # the list of subjects


def subjects_of(docs: DataFrame, labels: DataFrame, reference: DataFrame, places: DataFrame | None = None, share: float = SHARE, lexicon: Lexicon | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, subject) of every document: its subjects, or GENERAL if it has none.

    docs: doc_id, text, source, and property_id where there are places (property_id, address), each property once; labels: doc_id, subject; reference: subject, and optionally label_en and
    label_ja. Null, empty and blank texts have no row. Repeated rows count once; labels of unknown subjects or documents don't
    matter; without labels the reference's own words decide. A lexicon learned elsewhere may be given.
    """
    names = _names(reference)
    lexicon = lexicon or learn_lexicon(docs, labels, reference, names)
    seen = materialize(votes(docs, labels, lexicon, places, without))
    general = len(names) - 1
    table = docs.sparkSession.createDataFrame(learn_model(seen, lexicon).rows, "source int, address int, code int, post array<double>")  # bounded as the patterns are
    one = seen.select("doc_id", "h", "source", "address", F.explode_outer("codes").alias("code"))
    met = one.join(F.broadcast(table), ["source", "address", "code"], "left")
    means = met.groupBy("doc_id", "h").agg(*(F.avg(F.get("post", F.lit(k))).alias(f"p{k}") for k in range(general)))
    found = F.filter(F.array(*(F.when(F.col(f"p{k}") >= share, F.lit(names[k])) for k in range(general)), F.lit(None).cast("string")), lambda x: x.isNotNull())
    return means.select("doc_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL)))).alias("subject")).distinct()


def accuracies(docs: DataFrame, labels: DataFrame, reference: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(function, accuracy, coverage): what the latent model learned of each labelling function, and its share of sentences with a vote."""
    lexicon = learn_lexicon(docs, labels, reference, _names(reference))
    model = learn_model(materialize(votes(docs, labels, lexicon, places)), lexicon)
    return docs.sparkSession.createDataFrame(model.accuracies, "function string, accuracy double, coverage double")
