"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters look at whole texts and fire or stay silent.  Some are fixed: word lists in four languages, phrases, patterns.
The others are induced: words and word stems (the first 3 to 8 characters) that far more toxic than clean labelled
documents hold, once or at least twice.  Labelled rows are a bounded sample of ``LABELLED`` rows, training rows only.

The label model has a hidden style for every document, ``STYLES`` toxic ones and two clean ones (short and long texts fire
differently, and so do languages), and for each voter and style how often it fires; these are its accuracies.  Voters
are not independent: a stem's voters fire together, and so does a word with its own stem.  So each voter also depends on
one other: the tree of strongest dependence within the styles (mutual information, given the style), fitted to pair
counts over all documents under the first styles, which start at voters that fire apart from one another (without the
tree, steps would take a block of copies for the class).  Everything else is estimated by expectation-maximisation over
all documents; a training label takes part as one more voter that is right in 99 of 100 cases.  Documents with the same votes are one row with a count, and a step moves sums only.

The classifier is a logistic regression on words and stems (held once, held twice) and the fixed voters.  It is fitted
to the posteriors of all documents that are not held out, by accelerated gradient steps, each a pass over a compact table of
feature numbers.  Sums are whole numbers of small units, so that neither order nor partitions change them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import shared_root, stash, unstash

#: Labelled rows that take part at most, those of the smallest hashed ids.
LABELLED = 500_000
#: Words and stems that are counted in clean documents; induced voters; features of the classifier: the strongest each.
CANDIDATES, INDUCED, FEATURES = 65_536, 96, 4096
#: Documents that hold an induced voter or a feature at least, standard errors and times by which toxic documents
#: hold it more often than clean ones.
SEEN, SURE, LIFT = 3, 3.0, 2.0
#: Lengths of stems, and characters of a text that are split into words at once.
STEMS, AT_ONCE = range(3, 9), 1 << 20
#: Steps of the label model and of the classifier; its L2 weight.
MODEL_STEPS, FIT_STEPS, RIDGE = 8, 25, 1e-5
#: Toxic styles of the label model; log odds of a training label; units in which posteriors and gradients are summed.
STYLES, GOLD, UNITS = 8, float(np.log(99)), 1 << 20
#: Words that a task gathers before their counts leave; sums that move in one row.
GATHER, STRETCH = 1_000_000, 4096

# Common insults and abusive phrases of four languages.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb fool loser losers trash scum garbage clown pathetic worthless disgusting imbecile jerk creep filth vermin",
    "de": "idiot idioten dumm dummkopf trottel depp abschaum ekelhaft wertlos versager armselig widerlich schwachkopf",
    "fr": "idiot idiote imbécile crétin crétine débile ordure minable dégoûtant stupide abruti vermine",
    "es": "idiota imbécil estúpido estúpida tonto tonta basura asqueroso escoria patético payaso inútil",
}
THREATS = "kill killed die hurt beat punch stab shoot burn destroy töten sterben tuer mourir matar morir"
PHRASES = "shut up|go to hell|drop dead|nobody likes you|halt die klappe|fahr zur hölle|ta gueule|va au diable|cállate|vete al infierno"
# End of fixed values.

WORD = re.compile(r"\w+")
SHOUT = re.compile(r"(?:\b[^\W\d_a-z]{4,}\b\W+){3}")
MASKED = re.compile(r"\b\w\*{2,}\w?\b")
SECOND = frozenset("you your youre ur du dich dir dein tu te toi ton vous tú ti usted".split())
LISTS = [(name, frozenset(words.split())) for name, words in {**INSULTS, "threat": THREATS}.items()]
PHRASE_LIST = PHRASES.split("|")


def word_counts(text: str) -> Counter:
    """How often each lower-cased word occurs; long texts are split piece by piece, cut at blanks."""
    out, a = Counter(), 0
    while a < len(text):
        b = a + AT_ONCE
        if b < len(text):
            b = max((text.find(c, b) for c in " \n"), default=-1)
            b = len(text) if b < 0 else b
        out.update(WORD.findall(text[a:b].lower()))
        a = b
    return out


def fixed_votes(text: str, counts: Counter) -> list[bool]:
    """The fixed voters: each word list once and twice, an insult beside an address, phrases, shouting, marks, masked words."""
    held = [sum(counts[w] for w in words if w in counts) for _, words in LISTS]
    insults = sum(held[:-1])
    addressed = any(w in counts for w in SECOND)
    low = text.lower()
    votes = [n >= k for n in held for k in (1, 2)]
    votes += [insults >= 3, insults > 0 and addressed, held[-1] > 0 and addressed, any(p in low for p in PHRASE_LIST)]
    return votes + [SHOUT.search(text) is not None, "!!!" in text, "?!" in text, "**" in text and MASKED.search(text) is not None]


FIXED = 2 * len(LISTS) + 8


class Lexicon:
    """Words and stems by number; a form is ``=word`` or ``stem*``."""

    def __init__(self, forms: list[str]):
        self.size = len(forms)
        self.words = {f[1:]: i for i, f in enumerate(forms) if f[0] == "="}
        self.stems = {f[:-1]: i for i, f in enumerate(forms) if f[0] != "="}
        self.heads = {w[:3] for w in (*self.words, *self.stems)}

    def held(self, counts: Counter) -> dict[int, int]:
        """How often a document holds each form that it has."""
        out: dict[int, int] = {}
        for w, c in counts.items():
            if w[:3] in self.heads:
                if (i := self.words.get(w)) is not None:
                    out[i] = out.get(i, 0) + c
                for k in STEMS:
                    if k > len(w):
                        break
                    if (i := self.stems.get(w[:k])) is not None:
                        out[i] = out.get(i, 0) + c
        return out


def forms_of(counts: Counter) -> Counter:
    """All forms of a document's words."""
    out = Counter()
    for w, c in counts.items():
        out["=" + w] += c
        for k in STEMS:
            if k > len(w):
                break
            out[w[:k] + "*"] += c
    return out


def _forms(batches):
    """form, once, twice: in how many documents of a partition each form stands so often."""
    once, twice = Counter(), Counter()

    def rows():
        batch = pa.RecordBatch.from_arrays([pa.array(list(once), pa.string()), pa.array(list(once.values()), pa.int64()), pa.array([twice[f] for f in once], pa.int64())], ["form", "once", "twice"])
        once.clear(), twice.clear()
        return batch

    for batch in batches:
        for t in batch.column("text").to_pylist():
            mine = forms_of(word_counts(t))
            once.update(mine.keys())
            twice.update(f for f, c in mine.items() if c > 1)
            if len(once) > GATHER:
                yield rows()
    yield rows()


def labelled_texts(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(texts, gold): text, toxic of the training sample, and its doc_id, gold.  An id labelled twice is toxic if one label says so."""
    learn = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    one = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("gold"))
    gold = stash(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "gold")
    return docs.join(F.broadcast(gold), "doc_id").select("text", "gold"), gold  # bounded by ``limit`` rows of 12 bytes


def held_out(doc_id):
    """Whether a row's label must not be learnt from; a null id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def induced(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Forms and, by form and level (once, twice), the standard errors by which toxic texts hold it more often; 0 if not sure."""
    n = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in texts.groupBy("gold").count().collect()}
    if not n[0] or not n[1]:
        return [], np.zeros((0, 2))
    found = texts.where("gold = 1").select("text").mapInArrow(_forms, "form string, once long, twice long")
    summed = found.groupBy("form").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).where(F.col("once") >= SEEN)
    top = summed.orderBy(F.desc("once"), "form").limit(CANDIDATES).collect()
    forms, toxic = [r.form for r in top], np.array([[r.once, r.twice] for r in top], float).reshape(-1, 2)
    lexicon = Lexicon(forms)

    def count(batches):
        sums = np.zeros((lexicon.size, 2), np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                mine = lexicon.held(word_counts(t))
                sums[np.fromiter(mine, np.int64, len(mine)), 0] += 1
                sums[[i for i, c in mine.items() if c > 1], 1] += 1
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some, 0]), pa.array(sums[some, 1])], ["i", "once", "twice"])

    clean = np.zeros_like(toxic)
    for r in texts.where("gold = 0").select("text").mapInArrow(count, "i long, once long, twice long").groupBy("i").agg(F.sum("once"), F.sum("twice")).collect():
        clean[r[0]] = r[1], r[2]
    p, q = toxic / n[1], clean / n[0]
    both = (toxic + clean) / (n[0] + n[1])
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    return forms, np.where((toxic >= SEEN) & (z >= SURE) & (p >= LIFT * q), z, 0.0)


def chosen(forms: list[str], z: np.ndarray) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(voters, features): (form, level) of the strongest; of forms that say the same in one word family one votes."""
    order = sorted(zip(*np.nonzero(z)), key=lambda x: (-z[x], -len(forms[x[0]]), forms[x[0]], x[1]))
    features, voters, families = [(forms[i], int(level)) for i, level in order[:FEATURES]], [], set()
    for i, level in order:
        family = (round(float(z[i, level]), 6), level, forms[i].strip("=*")[:3])
        if family not in families and len(voters) < INDUCED:
            families.add(family)
            voters.append((forms[i], int(level)))
    return voters, features


def read(docs: DataFrame, voters: list[tuple[str, int]], features: list[tuple[str, int]]) -> DataFrame:
    """doc_id, gold, v0, v1 (votes, 63 a number), f (numbers of features); one row per row of ``docs``."""
    forms = sorted({f for f, _ in (*voters, *features)})
    lexicon, at = Lexicon(forms), {f: i for i, f in enumerate(forms)}
    votes_of, features_of = [[] for _ in forms], [[] for _ in forms]
    for out, pairs in ((votes_of, voters), (features_of, features)):
        for k, (f, level) in enumerate(pairs):
            out[at[f]].append((level, k + FIXED))

    def run(batches):
        for batch in batches:
            v, f = [], []
            for t in batch.column("text").to_pylist():
                counts = word_counts(t)
                fixed = fixed_votes(t, counts)
                bits, mine = sum(1 << k for k, x in enumerate(fixed) if x), [k for k, x in enumerate(fixed) if x]
                for i, c in lexicon.held(counts).items():
                    bits |= sum(1 << k for level, k in votes_of[i] if c > level)
                    mine += [k for level, k in features_of[i] if c > level]
                v.append(bits)
                f.append(sorted(mine))
            low = (1 << 63) - 1
            out = [pa.array([x & low for x in v], pa.int64()), pa.array([x >> 63 for x in v], pa.int64()), pa.array(f, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("gold"), *out], ["doc_id", "gold", "v0", "v1", "f"])

    return docs.select("doc_id", "gold", "text").mapInArrow(run, "doc_id long, gold int, v0 long, v1 long, f array<int>")


def unpacked(v0: np.ndarray, v1: np.ndarray, size: int) -> np.ndarray:
    """Votes as a matrix of zeros and ones."""
    bits = [np.unpackbits(x.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :63] for x in (v0, v1)]
    return np.concatenate(bits, axis=1)[:, :size]


class LabelModel:
    """Shares of styles, each voter's rates by style and by the vote of the voter that it depends on (itself: on none).

    ``toxic`` says which styles are toxic.
    """

    def __init__(self, toxic: np.ndarray, size: int):
        self.toxic, self.size, self.parent = np.asarray(toxic, bool), size, np.arange(size)
        self.shares = np.full(len(self.toxic), -np.log(len(self.toxic)))
        self.rates = np.zeros((len(self.toxic), size, 2, 2))  # log probability: style, voter, vote of its parent, own vote

    @classmethod
    def seeded(cls, sums: np.ndarray, size: int, styles: int = STYLES) -> LabelModel:
        """A first model from the pair counts of clean and toxic labelled rows (:func:`label_sums`).

        Each toxic style starts at what fires with one voter, each next voter being the one that fires most without any
        of those before it; the last style is all toxic rows.
        """
        n, pairs = sums[:2].astype(float), sums[2:].reshape(2, size, size).astype(float)
        own = np.diag(pairs[1])
        apart, seeds = own.copy(), []
        while len(seeds) < styles - 1 and size and apart.max() >= SEEN:
            seeds.append(int(apart.argmax()))
            apart = np.minimum(apart, own - pairs[1][seeds[-1]])
        clean = (np.diag(pairs[0]) + 0.1) / (n[0] + 10)
        rates = [clean / 2, np.minimum(2 * clean, 0.9)] + [(pairs[1][s] + 0.5) / (own[s] + 1) for s in seeds] + [(own + 0.5) / (n[1] + 5)]
        weight = np.array([(n[0] + 1) / 2, (n[0] + 1) / 2, *(own[s] * (n[1] + 1) / (own[seeds].sum() + n[1] + 1) for s in seeds), (n[1] + 1) ** 2 / (own[seeds].sum() + n[1] + 1)])
        model = cls([False, False] + [True] * (len(rates) - 2), size)
        model.shares = np.log(weight / weight.sum())
        p = np.array(rates)
        model.rates = np.log(np.stack([1 - p, p], axis=-1))[:, :, None, :].repeat(2, axis=2)
        return model

    def above(self, x: np.ndarray) -> np.ndarray:
        """The vote of each voter's parent, 0 without one."""
        return np.where(self.parent == np.arange(self.size), 0, x[:, self.parent])

    def styles(self, x: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """The probability of each style for rows of votes; ``gold`` is 1, 0 or -1 (no label)."""
        up, voter = self.above(x), np.arange(self.size)
        score = np.stack([s + r[voter, up, x].sum(axis=1) for s, r in zip(self.shares, self.rates)], axis=1)
        score += np.where(gold == 1, GOLD, np.where(gold == 0, -GOLD, 0.0))[:, None] * self.toxic
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def posterior(self, x: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """The probability that a row is toxic."""
        return self.styles(x, gold)[:, self.toxic].sum(axis=1)

    def weights(self, x: np.ndarray, gold: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whole units of each style for every row."""
        return np.rint(self.styles(x, gold).T * UNITS).astype(np.int64) * counts

    def sums(self, x, gold, counts, by: LabelModel | None = None) -> np.ndarray:
        """What :meth:`fit` needs, under the styles of ``by`` (this model, if none is given)."""
        w, up = (by or self).weights(x, gold, counts), self.above(x)
        out = np.zeros((len(w), self.size, 2, 2), np.int64)
        for a in (0, 1):
            for b in (0, 1):
                out[:, :, a, b] = w @ ((up == a) & (x == b)).astype(np.int64)
        return np.concatenate([w.sum(axis=1), out.ravel()])

    def pair_sums(self, x, gold, counts) -> np.ndarray:
        w, y = self.weights(x, gold, counts), x.astype(np.int64)
        return np.concatenate([w.sum(axis=1), *((y * one[:, None]).T @ y for one in w)], axis=None)

    def fit(self, sums: np.ndarray) -> None:
        n = len(self.toxic)
        total, table = sums[:n] / UNITS, sums[n:].reshape(n, self.size, 2, 2) / UNITS
        self.shares = np.log((total + 1) / (total.sum() + n))
        self.rates = np.log((table + 0.1) / (table.sum(axis=3, keepdims=True) + 0.2))

    def depend(self, sums: np.ndarray, least: float = 1e-4) -> None:
        """The tree of greatest mutual information of voters, given the style; weaker links than ``least`` are left out."""
        n, v = len(self.toxic), self.size
        total, information = sums[:n] / UNITS, np.zeros((self.size, self.size))
        for share, pairs in zip(total, (sums[n:] / UNITS).reshape(n, v, v)):
            p11 = pairs / max(share, 1e-9)
            one = np.diag(p11)
            cells = [(p11, one[:, None] * one), (one[:, None] - p11, one[:, None] * (1 - one)), (one - p11, (1 - one[:, None]) * one), (1 - one[:, None] - one + p11, (1 - one[:, None]) * (1 - one))]
            information += share / max(total.sum(), 1e-9) * sum(np.where(p > 1e-12, np.maximum(p, 1e-12) * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0.0) for p, q in cells)
        np.fill_diagonal(information, 0)
        best, link, parent = np.zeros(v), np.arange(v), np.arange(v)
        outside = np.ones(v, bool)
        while outside.any():
            i = int(np.where(outside, best, -1.0).argmax())
            outside[i] = False
            parent[i] = link[i] if best[i] > least else i
            closer = outside & (information[i] > best)
            best[closer], link[closer] = information[i][closer], i
        self.parent = parent


def label_sums(x: np.ndarray, gold: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows and pair counts of clean, then of toxic labelled rows."""
    y = x.astype(np.int64)
    each = [np.where(gold == c, counts, 0) for c in (0, 1)]
    return np.concatenate([np.array([w.sum() for w in each]), *((y * w[:, None]).T @ y for w in each)], axis=None)


def gathered(table: DataFrame, f, columns: list[str], length: int) -> np.ndarray:
    """The sum over all batches of the whole-number vectors that ``f`` makes of them.

    Each core reads its share of the compact table in two tasks at most and sends a row for each stretch of ``STRETCH``
    sums that is not all zeros; tasks that each take some of the stretches add them up.
    """

    def run(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += f(*(batch.column(c) for c in columns))
        parts = [(k, total[a : a + STRETCH]) for k, a in enumerate(range(0, length, STRETCH))]
        yield _sums([(k, x) for k, x in parts if x.any()])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist()):
                x = np.frombuffer(raw, np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield _sums(list(sums.items()))

    out = np.zeros(length, np.int64)
    cores = table.sparkSession.sparkContext.defaultParallelism
    sent = table.select(*columns).coalesce(2 * cores).mapInArrow(run, "k int, sums binary")
    for r in sent.repartition(-(-length // STRETCH), "k").mapInArrow(add, "k int, sums binary").collect():
        out[r.k * STRETCH : (r.k + 1) * STRETCH] += np.frombuffer(r.sums, np.int64)
    return out


def _sums(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["k", "sums"])


def numbers(column: pa.Array, null: int = -1) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def label_model(seen: DataFrame, size: int) -> LabelModel:
    """The model fitted to ``seen`` (v0, v1, gold), all rows of it."""
    patterns = stash(seen.groupBy("v0", "v1", "gold").agg(F.count("*").alias("n")), "votes")

    def over_all(f, length: int) -> np.ndarray:
        of = lambda v0, v1, gold, n: f(unpacked(numbers(v0), numbers(v1), size), numbers(gold), numbers(n))
        return gathered(patterns, of, ["v0", "v1", "gold", "n"], length)

    plain = LabelModel.seeded(over_all(label_sums, 2 + 2 * size * size), size)
    n = len(plain.toxic)
    tree = LabelModel(plain.toxic, size)
    tree.depend(over_all(plain.pair_sums, n + n * size * size))
    tree.fit(over_all(lambda *votes: tree.sums(*votes, by=plain), n + 4 * n * size))
    for _ in range(MODEL_STEPS - 1):
        tree.fit(over_all(tree.sums, n + 4 * n * size))
    unstash(seen.sparkSession, patterns)
    return tree


def margins(f: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, features, their rows) of a column of feature lists; the last weight is the constant."""
    n, idx = f.value_lengths().to_numpy(zero_copy_only=False), f.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    return np.bincount(row, weights=w[idx], minlength=len(n)) + w[-1], idx, row


def classifier(rows: DataFrame, size: int) -> np.ndarray:
    """Weights of a logistic regression of ``y`` (whole ``UNITS``) on the features ``f`` of all ``rows``, the constant last."""

    def curvature(f, y):
        n = f.value_lengths().to_numpy(zero_copy_only=False)
        idx = f.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros(size + 3, np.int64)
        out[:size] = np.bincount(idx, weights=np.repeat(n + 1, n), minlength=size)
        out[size:] = (n + 1).sum(), len(n), y.to_numpy(zero_copy_only=False).sum()
        return out

    bound = gathered(rows, curvature, ["f", "y"], size + 3)
    count, total, w = max(int(bound[size + 1]), 1), bound[size + 2] / UNITS, np.zeros(size + 1)
    rate = 1 / (bound[: size + 1] / (4 * count) + RIDGE)
    w[-1] = np.log((total + 1) / (count - total + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(FIT_STEPS):
        def slope(f, y, at=ahead):
            z, idx, row = margins(f, at)
            r = np.rint(UNITS / (1 + np.exp(-np.clip(z, -500, 500)))).astype(np.int64) - y.to_numpy(zero_copy_only=False)
            out = np.bincount(idx, weights=r[row], minlength=size + 1)
            out[-1] = r.sum()
            return np.rint(out).astype(np.int64)

        g = gathered(rows, slope, ["f", "y"], size + 1) / UNITS / count + RIDGE * np.append(ahead[:-1], 0.0)
        after, later = ahead - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        if float(g @ (after - w)) > 0:  # momentum leads uphill: start it anew
            later = 1.0
        ahead, w, t = after + ((t - 1) / later) * (after - w) * (later > 1), after, later
    return w


def score(docs: DataFrame, labels: DataFrame, *, limit: int = LABELLED, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from ``least`` on).

    Null and empty texts hold nothing and get the score of a text without features.  Null ids have no label and are not
    held out; repeated rows each count and get the same score.  Without toxic and clean training rows only the fixed
    voters speak.  Other columns are ignored; no rows give no rows.
    """
    shared_root(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample, gold = labelled_texts(texts, labels, limit)
    voters, features = chosen(*induced(sample))
    size, width = FIXED + len(voters), FIXED + len(features)
    seen = stash(read(texts.join(F.broadcast(gold), "doc_id", "left"), voters, features), "read")
    model = label_model(seen, size)

    def label(batches):
        for batch in batches:
            y = model.posterior(unpacked(numbers(batch.column("v0")), numbers(batch.column("v1")), size), numbers(batch.column("gold")))
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(np.rint(y * UNITS).astype(np.int64))], ["f", "y"])

    learn = stash(seen.where(~held_out(F.col("doc_id"))).select("v0", "v1", "gold", "f").mapInArrow(label, "f array<int>, y long"), "posteriors")
    w = classifier(learn, width)

    def rate(batches):
        for batch in batches:
            z = margins(batch.column("f"), w)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    rated = seen.select("doc_id", "f").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
