"""Language identification in two steps: the family, then linear SVMs of language pairs inside it.

A family is chosen by one-versus-rest linear support vector machines, the language within it by
one-versus-one machines.  All read shares of hashed byte n-grams of the lower-cased letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.token_ids import slices

#: Families of languages by ISO 639-1 code.  A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNDETERMINED = "und"
SIZES = (2, 3, 4)
BUCKETS = 1 << 12
#: Labelled documents per language that training reads, at most.
SAMPLE_PER_LANGUAGE = 600
#: Words of the snippets that are cut from every document in the sample, so that short texts are learnt too.
SNIPPETS = (3, 12)
EPOCHS = 8
_WINDOW = 1 << 18
#: Rows that are judged at once.
ROWS = 256
_SCALE = 20.0


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"family:{lang}")


def letters(texts):
    """Arrow strings: lower case, every run of other than letters one blank, a blank at both ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), " ", "")
    return pc.replace_substring_regex(padded, r"\P{L}+", " ")


def _buffers(array):
    """Bytes of all strings end to end, and where each starts, with the end as one more."""
    import numpy as np

    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _hashes(raw, size: int):
    """Bucket of the n-gram that starts at each byte but the last ``size - 1``."""
    import numpy as np

    n = len(raw) - size + 1
    h = raw[:n].astype(np.uint32)
    for k in range(1, size):
        h = h * np.uint32(0x01000193) + raw[k : k + n]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def example(text: bytes):
    """Sparse features of one normalised text: places (uint16) and shares (float32), by n-gram size."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    places, values = [], []
    for i, size in enumerate(SIZES):
        if len(raw) >= size:
            found, counts = np.unique(_hashes(raw, size), return_counts=True)
            places.append(found + i * BUCKETS)
            values.append(counts * (_SCALE / counts.sum()))
    if not places:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    return np.concatenate(places).astype(np.uint16), np.concatenate(values).astype(np.float32)


def margins(texts, weights, bias):
    """Margins (documents x machines) of normalised Arrow strings.

    Works through the bytes in windows, so memory doesn't grow with the length of a text.
    """
    import numpy as np

    raw, bounds = _buffers(texts)
    starts, ends = bounds[:-1], bounds[1:]
    out = np.zeros((len(starts), len(bias)))
    for i, size in enumerate(SIZES):
        share = _SCALE / np.maximum(ends - starts - size + 1, 1)
        for low in range(0, len(raw) - size + 1, _WINDOW):
            high = min(low + _WINDOW, len(raw) - size + 1)
            h = _hashes(raw[low : high + size - 1], size) + np.uint32(i * BUCKETS)
            across = (ends[:, None] - np.arange(1, size)).ravel()  # starts of n-grams that would reach into the next text
            across = across[(across >= low) & (across < high)] - low
            first, last = np.searchsorted(starts, [low, high - 1], "right") - 1
            cuts = np.maximum(starts[first : last + 1] - low, 0)
            for m in range(len(bias)):
                v = weights[m].take(h)
                v[across] = 0
                out[first : last + 1, m] += np.add.reduceat(v, cuts, dtype=np.float64) * share[first : last + 1]
    return out + bias


def train_svm(examples, signs, seed: int):
    """Averaged hinge-loss descent over sparse examples; returns weights, bias and the slope of the margin's sigmoid."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, mean = np.zeros(len(SIZES) * BUCKETS), np.zeros(len(SIZES) * BUCKETS)
    b = mean_b = 0.0
    steps = EPOCHS * len(examples)
    done = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            places, values = examples[k]
            rate = 0.3 / (1 + 3 * done / steps)
            if signs[k] * (values @ w[places] + b) < 1:
                left = (steps - done) / steps  # part of the average that this change has
                change = rate * signs[k] * values
                w[places] += change
                mean[places] += left * change
                b += rate * 0.1 * signs[k]
                mean_b += left * rate * 0.1 * signs[k]
            done += 1
    m = np.array([signs[k] * (values @ mean[places] + mean_b) for k, (places, values) in enumerate(examples)])
    slopes = np.geomspace(0.25, 32, 29)
    slope = slopes[np.argmin([np.logaddexp(0, -s * m).mean() for s in slopes])]
    return mean.astype(np.float32), mean_b, float(slope)


@dataclass
class LanguageModel:
    """Machines of all families and pairs; ``predict`` works on a normalised Arrow string array."""

    languages: list[str]
    weights: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    slope: list = field(default_factory=list)
    families: dict = field(default_factory=dict)  # name -> its machine, or None if it is the only one
    pairs: dict = field(default_factory=dict)  # (a, b) -> the machine that is positive for a

    def add(self, examples, signs) -> int:
        w, b, s = train_svm(examples, signs, len(self.bias))
        self.weights.append(w)
        self.bias.append(b)
        self.slope.append(s)
        return len(self.bias) - 1

    def predict(self, texts):
        import numpy as np

        n = len(texts)
        seen = np.diff(_buffers(texts)[1]) > 1
        names, out = np.full(n, UNDETERMINED, object), np.zeros(n)
        if not self.languages or not n:
            return names, out
        chance = np.zeros((n, 0))
        if self.bias:
            m = margins(texts, self.weights, np.array(self.bias)) * np.array(self.slope)
            chance = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
        families = list(self.families)
        by_family = np.ones((n, 1)) if len(families) == 1 else np.stack([chance[:, self.families[f]] for f in families], 1)
        share = by_family / np.maximum(by_family.sum(1, keepdims=True), 1e-12)
        chosen = share.argmax(1)
        for i, family in enumerate(families):
            here = np.flatnonzero(seen & (chosen == i))
            members = [x for x in self.languages if family_of(x) == family]
            votes = np.zeros((len(here), len(members)))
            for (a, b), machine in self.pairs.items():
                if a in members:
                    votes[:, members.index(a)] += chance[here, machine]
                    votes[:, members.index(b)] += 1 - chance[here, machine]
            rivals = max(1, len(members) - 1)
            votes = votes / rivals if len(members) > 1 else votes + 1.0
            best = votes.argmax(1)
            names[here] = np.array(members, object)[best]
            out[here] = share[here, i] * votes[np.arange(len(here)), best]
        return names, np.clip(out, 0, 1)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the columns doc_id, text and lang of ``labelled``.

    At most ``per_language`` documents of each language are read, those with the lowest hash of
    doc_id; executors turn them into features, the driver gets features alone.  Rows without text,
    language or letters teach nothing.
    """
    import numpy as np

    rows = labelled.where("lang is not null and text is not null").select(F.col("lang"), F.col("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A little more than wanted by the mean, cut to the bound below.
    taken = rows.join(F.broadcast(counts), "lang").where(F.col("draw") * F.col("n") <= F.lit(1.3 * per_language * (1 << 30)) + F.lit(30 * (1 << 30)))

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for lang, text, draw in zip(batch.column(0).to_pylist(), letters(batch.column(1)).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                cuts = [text] + [" " + " ".join(words[draw % max(1, len(words) - k) :][:k]) + " " for k in SNIPPETS]
                if words:
                    for part, cut in enumerate(cuts):
                        places, values = example(cut.encode())
                        out.append((lang, draw, part, places.astype("<u2").tobytes(), values.astype("<f4").tobytes()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "draw", "part", "places", "values"])

    found = taken.mapInArrow(featurise, "lang string, draw bigint, part bigint, places binary, values binary").collect()
    found.sort(key=lambda r: (r.lang, r.draw, r.part, r.places))
    examples, langs, seen = [], [], {}
    for r in found:
        if seen.get(r.lang, 0) < per_language * (1 + len(SNIPPETS)):
            seen[r.lang] = seen.get(r.lang, 0) + 1
            examples.append((np.frombuffer(r.places, "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4")))
            langs.append(r.lang)
    model = LanguageModel(sorted(seen))
    groups = [family_of(x) for x in langs]
    names = sorted(set(groups))
    for name in names:
        if len(names) == 2 and model.families:
            # Two families need one machine; the second is its mirror image.
            first = model.families[names[0]]
            model.weights.append(-model.weights[first])
            model.bias.append(-model.bias[first])
            model.slope.append(model.slope[first])
            model.families[name] = first + 1
        elif len(names) > 1:
            model.families[name] = model.add(examples, [1.0 if g == name else -1.0 for g in groups])
        else:
            model.families[name] = None
    for name in names:
        for a, b in combinations([x for x in model.languages if family_of(x) == name], 2):
            mine = [k for k, x in enumerate(langs) if x in (a, b)]
            model.pairs[a, b] = model.add([examples[k] for k in mine], [1.0 if langs[k] == a else -1.0 for k in mine])
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[Column] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of every row, and the predicted language and its score under these ``names``.

    Null texts and texts without a letter are ``und`` with score 0; an empty table gives an empty
    result.  Rows that repeat are judged alike; columns not named in ``keep`` are not read.
    """
    text = free_name(docs, "__text")
    kept = docs.select(*keep, F.col("text").alias(text))
    columns = kept.drop(text)
    names_kept = columns.columns

    def judge(batches):
        import pyarrow as pa

        # A few rows at a time: the copies that normalising makes stay small.
        for part in slices(batches, len(names_kept), ROWS):
            langs, score = model.predict(letters(part.column(part.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=[*names_kept, *names])

    return kept.mapInArrow(judge, _schema_with(columns, f"{names[0]} string, {names[1]} double"))


def _schema_with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType(list(df.schema.fields) + list(StructType.fromDDL(more).fields))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with more underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out; null texts and texts without letters are ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return identify(docs, model, [F.col("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out")])
