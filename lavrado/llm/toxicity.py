"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult (words and stems learned from labels, each with a weight), verb of harm, target,
negation, verb of saying or other; marks become symbols too.  Three transducers (see grammar), for negation, reported
speech and targets, are composed into one machine, and the best path through a line says what each insult and verb
of harm is: plain, directed, negated, reported or a threat.  Each kind sums its words' weights; a logistic
model of the kinds' sums, fitted on labelled documents, gives the score.

Plan: a bounded hash sample of labelled rows; two aggregations find the words and stems whose log-odds of a
toxic document are significant for this sample, a toxic document counting only with a context of its own so
that copies of one text count once; a third gives the kinds' sums of the sample's rows; then a row-local pass
over all texts.  What is sent out is the words and stems that are significant in the sample.
"""

from __future__ import annotations

import hashlib
import re

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .grammar import NEAR, best, machine
from .language_id import held_out
from .shared import documents, small_batches, staged, table

#: Labelled rows of each label that the lexicon and the weights are fitted on, in expectation.
TRAIN_ROWS = 4000
#: Letters of the shortest stem.
SHORT = 4
KINDS = ("plain", "directed", "negated", "reported", "threat")
WRITTEN = {z: k for k, z in enumerate("PDNRT")}

#: How regular verbs are inflected: endings that are put to a stem.
ENDINGS = {
    "en": " s ed ing", "en_e": "e es ed ing", "de": "e st t en te test ten tet end", "de_t": "e est et en ete etest eten etet end",
    "fr_er": "e es ons ez ent er é és ée ées ais ait aient erai eras era erons erez eront erais erait ant", "fr_ir": "is it ir i is ie irai iras ira irons irez iront issez issent issant",
    "es_ar": "o as a amos áis an ar aste ó aron aba aban aré arás ará aremos arán aría ado ada ados adas ando", "es_e": "é e es emos en", "es_uir": "uyo uyes uye uimos uyen uir uí uyó uyeron uiré uirás uirá uiremos uirán uido uida uyendo uya",
}
# Fixed word lists, English, German, French and Spanish: stems of regular verbs of harm, and forms of the others.
STEMS = {
    "en": "kill murder harm destroy crush punish burn slaughter smash", "en_e": "strangl chok", "de": "verletz zerstör verprügel verbrenn erwürg", "de_t": "töt ermord", "fr_er": "tu bless frapp étrangl brûl assassin", "fr_ir": "pun",
    "es_ar": "mat golpe peg quem castig estrangul asesin", "es_e": "mat golpe pegu quem castigu estrangul asesin", "es_uir": "destr",
}
OTHER_FORMS = (
    "stab stabs stabbed stabbing shoot shoots shot shooting hurt hurts hurting beat beats beaten beating burnt"
    " getötet verprügeln umbringen umbringe umbringst umbringt umgebracht bringe erschlagen erschlage erschlägt erschlug schlagen schlage schlägst schlägt schlug geschlagen verbrannt verbrannte"
    " détruire détruis détruit détruisent détruirai détruira détruiront herir hiero hieres hiere herí hirió herido herida heriré herirá herirás"
)
# Forms that are everyday words of another of the languages.
ELSEWHERE = frozenset(("tue", "mate", "mates"))
HARM = (frozenset(f"{stem}{end}" for kind, stems_ in STEMS.items() for stem in stems_.split() for end in ENDINGS[kind].split(" ")) | frozenset(OTHER_FORMS.split())) - ELSEWHERE
TARGET = frozenset("you your he she they him her them this these are du dich dir dein deine ihr euch er sie sind tu te toi ton ta vous votre il elle ils elles lui tú ti tu usted ustedes él ella ellos ellas lo la les son".split())
NEGATION = frozenset("not never no nor neither nicht nie niemals kein keine keiner weder pas jamais aucun aucune nunca ni ningún ninguna jamás".split())
SAYING = frozenset("said says say quoted quotes wrote writes claimed claims called calls sagte sagt sagten schrieb schreibt behauptet behauptete dit disait écrit affirme prétend dijo dice decía escribió afirma afirmó".split())
_MARKS = {**dict.fromkeys(".!?;", "e"), ",": "c", ":": "k", **dict.fromkeys('"“”„«»', "q")}
_MASK, _HALF = (1 << 64) - 1, 1 << 63
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r'[^\W\d_]+|[.!?;,:"“”„«»]')
_QUOTE, _END = re.compile('["“”„«»]'), re.compile("[.!?;]+")
_NOT = re.compile(r"n['’]t\b")


def stems(word: str, longest: int | None = None) -> list[str]:
    """The word itself and, marked, its first letters, of every length from SHORT (to `longest`)."""
    return [word, *(f"{word[:n]}*" for n in range(SHORT, len(word) if longest is None else min(len(word), longest + 1)))]


def stem_keys(word: str) -> list[int]:
    """A 64-bit key of each of stems(word), in one pass over the letters: a long word's stems aren't spelled out."""
    h, out = 0, []
    for c in word:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
        h ^= h >> 29
        out.append(h - _HALF)
    return [((h * 0xBF58476D1CE4E5B9 + 7) & _MASK) - _HALF, *out[SHORT - 1 : -1]]


def heads(lexicon: dict[str, float]) -> tuple[frozenset[str], int]:
    """The first letters that words of the lexicon have, and the length of its longest stem."""
    return frozenset(s[:SHORT] for s in lexicon), max((len(s) - 1 for s in lexicon if s.endswith("*")), default=0)


class Matcher:
    """The sum of weights of each kind of match in a text's lines."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000) -> None:
        self.lexicon, (self.first, self.longest) = lexicon, heads(lexicon)
        self.seen: dict[str, float | None] = {}
        self.most = most

    def weight(self, word: str) -> float | None:
        """An insult's weight, 0 for a verb of harm, else None; looked up once a word, for `most` words at a time."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= self.most:
            self.seen.clear()
        found = max(self.lexicon.get(s, 0.0) for s in stems(word, self.longest)) if word[:SHORT] in self.first else 0.0
        self.seen[word] = found if found else 0.0 if word in HARM else None
        return self.seen[word]

    def stretches(self, text: str) -> Iterator[str]:
        """Lines, and sentences of lines without a quotation, as only that goes on from one sentence to the next."""
        for line in text.splitlines():
            if _QUOTE.search(line):
                yield line
            else:
                yield from _END.split(line)

    def __call__(self, text: str) -> list[float]:
        out = [0.0] * len(KINDS)
        for part in self.stretches(text.lower()):
            found = {w: x for w in set(_WORD.findall(part)) if (x := self.weight(w)) is not None}
            if not found:
                continue
            symbols, weights, run = [], [], 0
            for token in _TOKEN.findall(_NOT.sub(" not", part)):
                x = found.get(token)
                if x is not None:
                    symbol = "i" if x else "h"
                elif token in _MARKS:
                    symbol = _MARKS[token]
                else:
                    symbol = "n" if token in NEGATION else "r" if token in SAYING else "t" if token in TARGET else "w"
                run = run + 1 if symbol == "w" else 0
                if run <= NEAR + 1:  # so many other words in a row are like any larger number
                    symbols.append(symbol)
                    weights.append(x or 1.0)
            for z, x in zip(best(machine(), "".join(symbols) + "z"), weights):
                if (kind := WRITTEN.get(z)) is not None:
                    out[kind] += x
        return out


def matches(text: str, lexicon: dict[str, float]) -> list[float]:
    return Matcher(lexicon)(text)


def _tallied(batches: Iterator) -> Iterator:
    import pyarrow as pa

    seen: dict[int, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for s in {s for w in set(_WORD.findall(text.lower())) for s in stem_keys(w)}:
                seen.setdefault(s, [0, 0])[label] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["key", "clean", "toxic"])


def _in_context(wanted) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own, out = wanted.value, set()
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                    met = [(k, n) for n, k in enumerate(stem_keys(w), SHORT - 1) if k in own]
                    if met:
                        context = hashlib.md5(f"{a} {w} {b}".encode()).digest()
                        out.update((k, w if n < SHORT else f"{w[:n]}*", context) for k, n in met)
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["key", "stem", "context"])

    return run


def _summed(model) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        match = None
        for batch in batches:
            match = match or Matcher(model.value)
            rows = [match(t) if t else [0.0] * len(KINDS) for t in batch.column("text").to_pylist()]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, pa.list_(pa.float64()))], [*kept, "kinds"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic model, by Newton's method; both labels weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    share = len(y) / 2 / np.maximum(1, np.array([(y != 1).sum(), (y == 1).sum()]))[(y == 1).astype(int)]
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (share * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log likelihood ratio of a larger share in toxic documents against an equal one; 0 if it isn't larger."""
    part = lambda k, n, p: k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))
    t, c = np.asarray(toxic, dtype=np.float64), np.asarray(clean, dtype=np.float64)
    both = (t + c) / (n1 + n0)
    ratio = part(t, n1, t / n1) + part(c, n0, c / n0) - part(t, n1, both) - part(c, n0, both)
    return np.where(t / n1 > c / n0, 2 * ratio, 0.0)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log odds of a document with the stem among toxic documents against clean ones."""
    t, c = np.asarray(toxic, dtype=np.float64), np.asarray(clean, dtype=np.float64)
    return np.log((t + 0.5) / (n1 - t + 0.5)) - np.log((c + 0.5) / (n0 - c + 0.5))


def fitted(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from a table of text and label (0 or 1; other rows are left out).

    `rows` bounds the rows of each label that are learned from, in expectation; copies of a text are one row.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    usable = labelled.select("text", F.col("label").cast("int").alias("label")).where("text is not null and label in (0, 1)")
    usable = staged(usable.dropDuplicates(["text", "label"]), "labelled")
    sizes = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if sizes.keys() != {0, 1}:
        return {}, np.array([*[0.0] * len(KINDS), -3.0])
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])
    sample = staged(usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000), "sample")
    n0, n1 = (max(1, sample.where(F.col("label") == k).count()) for k in (0, 1))
    tally = sample.mapInArrow(_tallied, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    tried = staged(tally.where("toxic > 1"), "tried")
    # Of M stems without a leaning to toxic documents the luckiest one has an evidence of about 2 ln M.
    bound = 2 * np.log(max(2, tried.count()))
    part = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)
    t, c, both = F.col("toxic"), F.col("clean"), (F.col("toxic") + F.col("clean")) / (n0 + n1)
    judged = tried.where(t / n1 > c / n0).withColumn("evidence", 2 * (part(t, n1, t / n1) + part(c, n0, c / n0) - part(t, n1, both) - part(c, n0, both)))
    likely = judged.where(F.col("evidence") >= bound).toPandas()  # of the bounded sample
    wanted = spark.sparkContext.broadcast(frozenset(likely["key"].tolist()))
    contexts = sample.where("label = 1").select("text").mapInArrow(_in_context(wanted), "key long, stem string, context binary").groupBy("key", "stem").agg(F.countDistinct("context").alias("contexts"))
    met = contexts.toPandas().merge(likely, on="key")
    own = np.minimum(met["toxic"], met["contexts"])
    weights = log_odds(own, met["clean"], n1, n0)
    lexicon = {s: float(x) for s, x, e in zip(met["stem"], weights, evidence(own, met["clean"], n1, n0)) if e >= bound}
    shared = spark.sparkContext.broadcast(lexicon)
    found = sample.mapInArrow(_summed(shared), "label int, kinds array<double>").toPandas()  # the bounded sample
    x = np.log1p(np.array(found["kinds"].tolist()).reshape(-1, len(KINDS)))
    y = found["label"].to_numpy(dtype=np.float64)
    return lexicon, logistic(x, y)


def score(df: DataFrame, model: tuple[dict[str, float], np.ndarray], doc_id: str = "doc_id", text: str = "text", at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the kinds' sums for each row; null and empty texts have no match."""
    spark = df.sparkSession
    small_batches(spark)
    lexicon, w = model
    shared = spark.sparkContext.broadcast(lexicon)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_summed(shared), f"doc_id {dict(df.dtypes)[doc_id]}, kinds array<double>")
    z = F.lit(float(w[-1]))
    for k in range(len(KINDS)):
        z = z + F.log1p(F.col("kinds")[k]) * float(w[k])
    scored = rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), *[F.col("kinds")[k].alias(name) for k, name in enumerate(KINDS)])


def sampled(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Of (doc_id, label) rows a hash sample by doc_id of `rows` of each label in expectation, so small that it can be sent out."""
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect() if r[0] is not None}  # one row a label
    if not sizes:
        return labels.limit(0)
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # The sample is taken before the texts are joined, so that no text is shuffled but the sample's.
    return score(docs, fitted(docs.where(~held_out()).join(F.broadcast(sampled(labels)), "doc_id")))
