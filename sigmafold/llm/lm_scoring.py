"""Language-model scores of whole texts by causal self-attention over subword ids.

The model predicts the class of the next subword from the subwords before it: one attention layer in
numpy.  Every partition trains it on all its training texts, round by round, and the partitions' weights
are averaged after each.  A class is a set of subwords that keep the same company and that all begin a
word or all go on with one; company, ranks and how likely a subword is within its class come from the
whole training corpus.  The layer first tells whether a word begins or goes on, then which class of that
kind comes.  Every text is encoded once; whatever follows reads its ids, by which words are told apart,
as different words have different ids.  Texts are scored in overlapping windows: each window reads CONTEXT ids again and
scores the next STRIDE, so every id is scored once.

The chances of the next subword sum to one over the vocabulary.  A word's chance, given that a word or
the end comes next, is that of its subwords and of a word's end behind them; it is mixed with the word's
share of the training corpus.  As in the base score, all words that the training corpus lacks count as
one, the unknown word; its chance is the share of words that occur once (Good and Turing).  The chances
of the end, the known words and the unknown word sum to at most one, as some strings of subwords are no
known word's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.language_id import held_out
from sigmafold.llm.token_ids import PieceEncoder, WordMemory, gathered, keep_freed, slices
from sigmafold.runtime import materialise, release

WIDTH = 16
CONTEXT, STRIDE = 8, 24
LENGTH = CONTEXT + STRIDE
#: Classes of subwords that begin a word and of those that don't; then rare and unseen subwords of both kinds.
BEGINNING, INNER, RARE_CLASSES = 56, 36, 4
CLASSES = BEGINNING + INNER
#: Columns of the layer's scores: classes that begin a word, whether one begins, classes that don't.
KIND, COLUMNS = BEGINNING + RARE_CLASSES // 2, CLASSES + RARE_CLASSES + 1
#: Subwords with an embedding of their own, by frequency; the others share that of their class.
EMBEDDED = 4096
CLUSTERED = 1500
#: Subwords that tell apart what follows them within a word, and subwords counted behind each of them.
GROUPS, FOLLOWERS = 192, 8192
#: Weight of the class's shares against what was counted behind the subword before.
PRIOR = 100.0
#: The pass over all training texts: a text belongs to one round; the rate falls from round to round.
ROUNDS, ROUND_RATE, BATCH = 4, 0.015, 64
#: Distinct words that a worker remembers the ids of.
REMEMBERED = 300_000
#: Windows that are scored at once.
WINDOWS = 96
#: Words whose counts every executor knows; the counts of all others are joined.
FREQUENT = 400_000
FREQUENT_BYTES = 48
#: Part of a word's probability that comes from its share of the training corpus; the rest is the network's.
WORD_PART = 0.7
_GROUP, _GROUP_BYTES = 512, 1 << 22
#: Rows and bytes of text that are encoded at once: more, as words that repeat are looked up once.
_ENCODED, _ENCODED_BYTES = 2048, 1 << 23
#: Rows that are scored at once.
_JUDGED = 1024
_LOG10 = 2.302585092994046


def words_of(texts):
    """Words (A-Z in lower case, runs of other than blank and \\x09-\\x0D) of Arrow strings: flat, and how many each text has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(low)
    some = pc.not_equal(low, "")
    counts = np.where(some.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    return pc.list_flatten(lists.filter(some)), counts.astype(np.int64)


def _groups(batch, column: int = 0):
    """Parts of a batch of at most _GROUP rows and _GROUP_BYTES in ``column``."""
    return slices([batch], column, _GROUP, _GROUP_BYTES)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``; counted in each batch first."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in slices(batches, 0):
            words, _ = words_of(part.column(0))
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _gathered(sums: DataFrame, size: int, kind: str):
    """The numbers of (place, n) in an array of ``size``; they come to the driver as packed bytes."""
    import numpy as np

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy().astype(kind)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["place", "n"])

    out = np.zeros(size, kind)
    for r in sums.select("place", "n").mapInArrow(pack, "place binary, n binary").collect():
        out[np.frombuffer(r.place, np.int32)] = np.frombuffer(r.n, kind)
    return out


def spell(words: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) with the subword ids of each word, two bytes each, in place of its letters."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder = PieceEncoder.of(tokenizer, REMEMBERED)
        for batch in batches:
            ids, before = WordMemory.of(encoder).ids_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([_binary(np.ascontiguousarray(ids, np.uint16), 2 * before), batch.column(1)], names=["word", "n"])

    return words.select("word", "n").mapInArrow(encode, "word binary, n bigint")


def _binary(data, offsets):
    """An Arrow array of the bytes of ``data`` between ``offsets``."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _flat(column):
    """The bytes of an Arrow binary array end to end, and where each value begins in them (with the total as one more)."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def count_subwords(words: DataFrame, group_of, follower_of):
    """Counts over spelt words (word, n): of each subword (an array of the vocabulary's size), and of each
    follower behind each group of subwords within a word (GROUPS x FOLLOWERS)."""
    import numpy as np

    size = len(group_of)

    def count(batches):
        import pyarrow as pa

        total, behind = np.zeros(size), np.zeros(GROUPS * FOLLOWERS)
        for batch in batches:
            data, before = _flat(batch.column(0))
            ids, before = np.frombuffer(data.tobytes(), np.uint16), before // 2
            weight = np.repeat(batch.column(1).to_numpy(), np.diff(before))
            total += np.bincount(ids, weight, size)
            inside = np.ones(len(ids), bool)
            inside[before[:-1][np.diff(before) > 0]] = False
            inside = np.flatnonzero(inside)
            group, follower = group_of[ids[inside - 1]], follower_of[ids[inside]]
            ok = (group >= 0) & (follower >= 0)
            behind += np.bincount(group[ok] * FOLLOWERS + follower[ok], weight[inside[ok]], len(behind))
        found = np.concatenate([total, behind])
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen].astype(np.int64))], names=["place", "n"])

    sums = words.select("word", "n").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    # At most one row per subword and per cell of the table of followers: both have a fixed size.
    found = _gathered(sums, size + GROUPS * FOLLOWERS, "f8")
    return found[:size].copy(), found[size:].reshape(GROUPS, FOLLOWERS)


def encode_texts(texts, encoder: PieceEncoder, end: int):
    """Subword ids of all words of each text and its end; the start of each text in them; words and word
    counts; the place of each word's first id."""
    import numpy as np

    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    ids, before = gathered(*WordMemory.of(encoder).ids_of(coded.dictionary), coded.indices.to_numpy())
    stops = before[np.cumsum(counts)]
    ends = np.arange(1, len(stops) + 1)
    return np.insert(ids, stops, np.uint16(end)), np.concatenate([[0], stops + ends]), coded, counts, before[:-1] + np.repeat(ends - 1, counts)


def windows(starts, stride: int = STRIDE, context: int = CONTEXT):
    """Place of every id that the windows of all texts read (windows x LENGTH + 1, -1 outside the text)."""
    import numpy as np

    sizes = np.diff(starts)
    each = -(-sizes // stride)
    text = np.repeat(np.arange(len(sizes)), each)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * stride - context
    # Column k+1 is scored from columns up to k: one column ahead of the window holds its last target.
    place = first[:, None] - 1 + np.arange(LENGTH + 1)
    return np.where((place >= 0) & (place < sizes[text][:, None]), place + starts[text][:, None], -1), text


@dataclass
class CausalModel:
    """Column and embedding row of every subword, its log share of the class, and the layer's weights."""

    class_of: object
    column_of: object
    row_of: object
    log_share: object
    group_of: object
    follower_of: object
    log_behind: object
    log_behind_other: object
    spaced: object
    weights: list

    @property
    def blank(self) -> int:
        """Embedding row of places before the text."""
        return len(self.weights[0]) - 1

    def log_chances(self, ids, starts):
        """Natural logs of each id's chance given those before it, and of the chance that a word or the end comes there.

        Batched masked attention over all windows; a batch is small enough that its arrays stay in the
        processor's cache.
        """
        import numpy as np

        place, _ = windows(starts)
        # A last entry stands for every place outside a text.
        row = np.append(self.row_of[ids], np.int16(self.blank))
        column = np.append(self.column_of[ids], np.int16(-1))
        out, begins = np.append(self.log_shares(ids, starts), 0.0), np.zeros(len(ids) + 1)
        for at in range(0, len(place), WINDOWS):
            part = place[at : at + WINDOWS]
            squashed, _ = self.forward(row.take(part[:, :-1]), CONTEXT)
            # Every id is the target of one window.
            target = part[:, CONTEXT + 1 :].ravel()
            for mine, wanted, span, kind in self.heads(column.take(target)):
                z = squashed.take(mine, 0) @ self.weights[4][:, span]
                to, sign = target.take(mine), z[:, kind].copy()
                # Logs of the chances that a word begins and that it goes on.
                beginning = -np.log1p(np.exp(-sign))
                picked = z[np.arange(len(z)), wanted]
                np.exp(z, out=z)
                out[to] += picked - np.log(z @ _classes(kind, z.shape[1])) + (beginning if kind else beginning - sign)
                begins[to] = beginning
        return out[:-1], begins[:-1]

    def heads(self, columns):
        """For each kind of class: where ``columns`` are of it, columns in its span of the scores, that span, and which column of it is for the kind itself."""
        import numpy as np

        for span, kind, mine in ((slice(0, KIND + 1), KIND, (columns >= 0) & (columns < KIND)), (slice(KIND, COLUMNS), 0, columns > KIND)):
            at = np.flatnonzero(mine)
            yield at, columns.take(at) - span.start, span, kind

    def log_shares(self, ids, starts):
        """Log share of each subword in its class, given the subword before it if both are of one word."""
        import numpy as np

        out = self.log_share[ids].astype(np.float64)
        at = np.flatnonzero(~self.spaced[ids])
        at = at[at > 0]
        first = np.zeros(len(ids) + 1, bool)
        first[starts] = True
        at = at[~first[at]]
        group, follower = self.group_of[ids[at - 1]], self.follower_of[ids[at]]
        counted = (group >= 0) & (follower >= 0)
        out[at[counted]] = self.log_behind[group[counted], follower[counted]]
        other = (group >= 0) & (follower < 0)
        out[at[other]] += self.log_behind_other[group[other], self.class_of[ids[at[other]]]]
        return out

    def forward(self, rows, skip: int = 0):
        """What the layer knows at each place of a window from ``skip`` on (with a one behind it); logits stay small, so no maximum is taken off."""
        import numpy as np

        embed, position, bilinear, mix, _ = self.weights
        x = embed.take(rows, 0)
        x += position
        # The values turned, and a one below each.
        turned = np.empty((len(rows), WIDTH + 1, rows.shape[1]), np.float32)
        turned[:, :WIDTH] = x.transpose(0, 2, 1)
        turned[:, WIDTH] = 1
        y = (x.reshape(-1, WIDTH) @ bilinear).reshape(x.shape)
        scores = np.matmul(y[:, skip:], turned[:, :WIDTH])
        np.minimum(scores, _most(len(rows))[:, skip:], out=scores)
        np.exp(scores, out=scores)
        norm = _across(scores.reshape(-1, rows.shape[1]) @ np.ones(rows.shape[1], np.float32))
        seen = np.matmul(scores, x).reshape(-1, WIDTH)
        seen /= norm
        inner = seen @ mix
        inner += x[:, skip:].reshape(-1, WIDTH)
        squashed = np.ones((len(inner), WIDTH + 1), np.float32)
        squashed[:, :WIDTH] = np.tanh(inner, out=inner)
        return squashed, (x, turned, y, scores, norm, seen, inner)


def _across(column, width: int = WIDTH):
    """``column`` in so many columns: arrays of one shape are multiplied faster than a column is spread along."""
    return column.repeat(width).reshape(-1, width)


_limits = None


def _most(n: int):
    """The most that an attention score may be in ``n`` windows: a place sees itself and what is before it."""
    global _limits
    if _limits is None or len(_limits) < n:
        import numpy as np

        limits = np.where(np.tril(np.ones((LENGTH, LENGTH), bool)), 30, -1e4).astype(np.float32)
        _limits = np.tile(limits, (max(n, BATCH, WINDOWS), 1, 1))
    return _limits[:n]


def _classes(kind: int, n: int):
    """Ones for the columns, of ``n``, that are classes."""
    import numpy as np

    ones = np.ones(n, np.float32)
    ones[kind] = 0
    return ones


def _gradients(model: CausalModel, rows, columns):
    """Gradients of one batch of windows (mean over the scored ids): of each place's embedding, and of the other weights.

    ``columns``: that of the id that comes behind each place, -1 outside a text.
    """
    import numpy as np

    _, _, bilinear, mix, out = model.weights
    squashed, (x, turned, y, scores, norm, seen, inner) = model.forward(rows)
    part = np.float32(1 / max(1, np.count_nonzero(columns >= 0)))
    heads = list(model.heads(columns))
    # Rows lie by kind; a last one, of zeros, is for places outside a text.
    dh, d_out, at = np.zeros((len(seen) + 1, WIDTH), np.float32), np.zeros_like(out), 0
    place = np.full(len(seen), len(seen))
    for mine, wanted, span, kind in heads:
        own, head, back = squashed.take(mine, 0), out[:, span], dh[at : at + len(mine)]
        place[mine] = np.arange(at, at + len(mine))
        at += len(mine)
        z = own @ head
        chance = 1 / (1 + np.exp(-z[:, kind]))
        np.exp(z, out=z)
        # The gradient of a row of scores, times what its classes sum to; that is made up for where rows are short.
        sums = z @ _classes(kind, z.shape[1])
        z[:, kind] = sums * (chance - 1 if kind else chance)
        z[np.arange(len(z)), wanted] -= sums
        sums = _across(part / sums, WIDTH + 1)
        own *= sums
        d_out[:, span] += own.T @ z
        np.matmul(z, head[:WIDTH].T, out=back)
        back *= sums[:, :WIDTH]
    dh = dh.take(place, 0)
    np.multiply(inner, inner, out=inner)
    dh *= np.subtract(1, inner, out=inner)
    d_mix = seen.T @ dh
    d_seen = dh @ mix.T
    d_seen /= norm
    # The attention's own gradient: what a place would gain beyond the mean of all that are seen.
    less = np.empty((*rows.shape, WIDTH + 1), np.float32)
    less[..., :WIDTH] = d_seen.reshape(x.shape)
    less[..., WIDTH] = -np.einsum("ij,ij->i", d_seen, seen).reshape(rows.shape)
    d_score = np.matmul(less, turned)
    d_score *= scores
    d_seen = d_seen.reshape(x.shape)
    dy = np.matmul(d_score, x).reshape(-1, WIDTH)
    dx = np.matmul(scores.transpose(0, 2, 1), d_seen)
    dx += np.matmul(d_score.transpose(0, 2, 1), y)
    dx = dx.reshape(-1, WIDTH)
    dx += dh
    dx += dy @ bilinear.T
    return dx, [dx.reshape(x.shape).sum(0), x.reshape(-1, WIDTH).T @ dy, d_mix, d_out]


def top_subwords(counts):
    """The most frequent subwords, in order: those that are put into classes by their company."""
    import numpy as np

    return np.argsort(-counts, kind="stable")[: min(CLUSTERED, int((counts > 0).sum()))]


def company_of(ids, starts, top, size: int):
    """How often each top subword has one of the first 400 of them 1, 2 and 6 places behind or before it in the texts: a row for each."""
    found = _company(ids, starts, top, size)
    return found.reshape(6, len(top), -1 if len(top) else 1).transpose(1, 0, 2).reshape(len(top), found.size // max(1, len(top)))


def _company(ids, starts, top, size: int):
    """The numbers of ``company_of``, a row for each kind of neighbour."""
    import numpy as np

    width = max(1, min(400, len(top)))
    company = np.zeros((6, len(top) * width))
    # As one of the pair, and as its neighbour; others, and the six places that part texts, are far below zero.
    one, two = np.full((2, size), -(1 << 29), np.int32)
    one[top] = np.arange(len(top)) * width
    two[top[:width]] = np.arange(min(width, len(top)))
    if not len(top):
        return company
    at = np.arange(len(ids)) + np.repeat(6 * np.arange(len(starts) - 1), np.diff(starts))
    a, b = np.full((2, len(ids) + 6 * len(starts)), -(1 << 29), np.int32)
    a[at], b[at] = one[ids], two[ids]
    for k, gap in enumerate((1, 2, 6)):
        for half, cell in enumerate((a[:-gap] + b[gap:], a[gap:] + b[:-gap])):
            company[2 * k + half] += np.bincount(cell[cell >= 0], minlength=company.shape[1])
    return company


def count_company(encoded: DataFrame, top, size: int):
    """``company_of`` over all texts of ``encoded``: a sum per partition, then one row per cell that occurs."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            for part in slices([batch], 0, _ENCODED, _ENCODED_BYTES):
                total += _company(*_decoded(part.column(0)), top, size)
        flat = np.ravel(total)
        seen = np.flatnonzero(flat)
        # A row of the table is all that a subword has: its six kinds of neighbours side by side.
        kind, one, two = seen // (len(top) * width), seen // width % len(top), seen % width
        yield pa.RecordBatch.from_arrays([pa.array(((one * 6 + kind) * width + two).astype(np.int32)), pa.array(flat[seen].astype(np.int64))], names=["place", "n"])

    width = max(1, min(400, len(top)))
    sums = encoded.select("ids").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    # The table has a fixed size: CLUSTERED x 6 x 400 cells at most.
    return _gathered(sums, len(top) * 6 * width, "f4").reshape(len(top), 6 * width)


def cluster_subwords(company, counts, spaced):
    """Class of every subword: frequent ones by the company they keep (see ``company_of``), the rest by count; no class has subwords of both kinds."""
    import numpy as np

    top = top_subwords(counts)
    out = np.where(spaced, CLASSES, CLASSES + 1) + np.where(counts > 0, 0, 2)
    if not len(top):
        return out.astype(np.int64)
    company = company.astype(np.float32, copy=False)
    expected = company.sum(1, keepdims=True) * company.sum(0, keepdims=True) / max(1.0, company.sum())
    # In place: the table has millions of cells, and this runs in the driver.
    np.log1p(expected, out=expected)
    lift = np.log1p(company, dtype=np.float32)
    lift -= expected
    del expected
    lift /= np.linalg.norm(lift, axis=1, keepdims=True) + 1e-6
    values, vectors = np.linalg.eigh(lift.T @ lift)
    x = lift @ vectors[:, -20:]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    rng, weight = np.random.default_rng(1), np.sqrt(counts[top] + 1.0)
    for kind, first, most in ((True, 0, BEGINNING), (False, BEGINNING, INNER)):
        mine = np.flatnonzero(spaced[top] == kind)
        n = min(most, len(mine))
        if not n:
            continue
        y, w = x[mine], weight[mine]
        centre = y[:n].copy()  # the most frequent subwords begin the classes
        for _ in range(15):
            label = (y @ centre.T).argmax(1)
            for c in range(n):
                members = label == c
                centre[c] = (y[members] * w[members, None]).sum(0) if members.any() else y[rng.integers(len(y))]
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-6
        out[top[mine]] = first + label
    return out.astype(np.int64)


def ranked_groups(counts):
    """Group and follower number of every subword (-1: none), by these counts."""
    import numpy as np

    size, rank = len(counts), np.argsort(-counts, kind="stable")
    group_of, follower_of = np.full(size, -1), np.full(size, -1)
    group_of[rank[:GROUPS]] = np.arange(min(GROUPS, size))
    follower_of[rank[:FOLLOWERS]] = np.arange(min(FOLLOWERS, size))
    return group_of, follower_of


class _Adam:
    """Steps of a model's weights by running means of the gradients and of their squares; embeddings that a batch doesn't read rest."""

    def __init__(self, model: CausalModel):
        import numpy as np

        self.model, self.n = model, 0
        model.weights[:] = [w.copy() for w in model.weights]
        self.first, self.second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]

    def step(self, row, column, part, rate: float) -> None:
        """One step on the windows ``part``, places in ``row`` and ``column`` (whose last entry is outside all texts)."""
        import numpy as np

        self.n += 1
        rows = row.take(part[:, :-1])
        each, grads = _gradients(self.model, rows, column.take(part[:, 1:]).ravel())
        # The sum of each embedding's gradients, by their order.
        rows = rows.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows.take(order)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        self._update(0, rows.take(first), np.add.reduceat(each.take(order, 0), first, 0), rate)
        for i, g in enumerate(grads, 1):
            self._update(i, None, g, rate)

    def _update(self, i: int, rows, g, rate: float) -> None:
        import numpy as np

        weights = kept = [self.model.weights[i], self.first[i], self.second[i]]
        if rows is not None:
            weights = [w.take(rows, 0) for w in kept]
        own, first, second = weights
        first *= np.float32(0.9)
        first += np.float32(0.1) * g
        second *= np.float32(0.99)
        g = g * g
        g *= np.float32(0.01)
        second += g
        size = np.multiply(second, np.float32(1 / (1 - 0.99**self.n)), out=g)
        np.sqrt(size, out=size)
        size += np.float32(1e-8)
        step = np.divide(first, size, out=size)
        step *= np.float32(rate / (1 - 0.9**self.n))
        own -= step
        if rows is not None:
            for w, new in zip(kept, weights):
                w[rows] = new


def prepare(counts, behind, group_of, follower_of, spaced, company, seed: int = 3) -> CausalModel:
    """The model before training: classes, shares and first weights.

    ``counts``, ``behind`` and ``company`` are those of the whole training corpus, see ``count_subwords``
    and ``count_company``.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    counts = counts.astype(np.float64)
    class_of = cluster_subwords(company, counts, spaced)
    n_classes = CLASSES + RARE_CLASSES
    of_class, members = np.bincount(class_of, counts, n_classes), np.bincount(class_of, minlength=n_classes)
    # A class without members gets no chance: its score stays low whatever the layer says.
    empty = members == 0
    log_share = np.log((counts + 0.5) / (of_class + 0.5 * members)[class_of])
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    row_of = np.where(rank < EMBEDDED, rank, EMBEDDED + class_of).astype(np.int16)
    rows = EMBEDDED + n_classes + 1
    # Clusters of either kind, and the rare classes, which take turns.
    column = np.concatenate([np.arange(BEGINNING), KIND + 1 + np.arange(INNER), *zip(range(BEGINNING, KIND), range(KIND + 1 + INNER, COLUMNS))])
    shapes = [(rows, WIDTH), (LENGTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH + 1, COLUMNS)]
    scale = [0.3, 0.1, 0.1, 0.25, 0.25]
    weights = [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(shapes, scale)]
    out = weights[4]
    out[:, column[empty]] = 0
    # The last row is the bias: of a class its share, of the kind how much more often a word begins than goes on.
    out[WIDTH, column] = np.where(empty, -60.0, np.log((of_class + 1) / (of_class + 1).sum()))
    out[WIDTH, KIND] = np.log((of_class[column < KIND].sum() + 1) / (of_class[column > KIND].sum() + 1))
    # Shares behind a group: what was counted, and PRIOR parts of the class's own shares.
    followers = np.flatnonzero(follower_of >= 0)
    followers = followers[np.argsort(follower_of[followers])]
    classes = class_of[followers]
    # Only what goes on with a word is counted behind a group.
    inner = ~spaced[followers]
    behind = behind[:, : len(followers)] * inner
    by_class = np.stack([np.bincount(classes, b, n_classes) for b in behind]) if len(followers) else np.zeros((len(behind), n_classes))
    log_behind = np.log(behind + PRIOR * np.exp(log_share[followers])) - np.log(by_class + PRIOR)[:, classes]
    log_other = np.log(PRIOR) - np.log(by_class + PRIOR)
    return CausalModel(class_of, column[class_of].astype(np.int16), row_of, log_share, group_of, follower_of, log_behind.astype(np.float32), log_other, spaced, weights)


def train_on(model: CausalModel, adam: _Adam, ids, starts, rng, rate: float) -> None:
    """Steps over all windows of these texts, in the order that ``rng`` deals; every id is predicted once."""
    import numpy as np

    row, column = np.append(model.row_of[ids], np.int16(model.blank)), np.append(model.column_of[ids], np.int16(-1))
    place = rng.permutation(windows(starts, LENGTH, 0)[0])
    for at in range(0, len(place), BATCH):
        adam.step(row, column, place[at : at + BATCH], rate)


def encode_rows(rows: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(doc_id, learn, round, ids, sizes, counted) of every row (doc_id, text, learn): the subword ids of its
    text and end, two bytes each; the round that trains on them; how many ids each word and the end have, see
    ``_packed_sizes``; and, in one of the rows that were encoded at once, the spelt words of those to learn from, counted."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        keep_freed()
        encoder = PieceEncoder.of(tokenizer, REMEMBERED)
        for part in slices(batches, 1, _ENCODED, _ENCODED_BYTES):
            ids, starts, coded, counts, firsts = encode_texts(part.column(1), encoder, end)
            marks = np.zeros(len(ids), bool)
            marks[firsts] = marks[starts[1:] - 1] = True
            units = np.append(np.flatnonzero(marks), len(ids))
            sizes, bounds = _packed_sizes(np.diff(units), np.concatenate([[0], np.cumsum(counts + 1)]))
            learn = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(bool), counts)
            which = coded.indices.to_numpy()
            n = np.bincount(which[learn], minlength=len(coded.dictionary))
            seen = np.flatnonzero(n)
            # The ids of a word are those of any place where it stands; behind the words of k texts are k ends.
            place = np.zeros(len(n), np.int64)
            place[which] = np.arange(len(which)) + np.repeat(np.arange(len(counts)), counts)
            flat, before = gathered(ids, units, place[seen])
            counted = pa.StructArray.from_arrays([_binary(flat, 2 * before), pa.array(n[seen])], names=["word", "n"])
            first = pa.array(np.append(0, np.full(part.num_rows, len(seen), np.int32)).astype(np.int32))
            columns = [part.column(0), part.column(2), part.column(3), _binary(np.ascontiguousarray(ids, np.uint16), 2 * starts), _binary(sizes, bounds), pa.ListArray.from_arrays(first, counted)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "round", "ids", "sizes", "counted"])

    chosen = rows.select("doc_id", "text", "learn", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int").alias("round"))
    return materialise(chosen.mapInArrow(encode, "doc_id bigint, learn boolean, round int, ids binary, sizes binary, counted array<struct<word:binary,n:bigint>>"), "ids")


def _packed_sizes(sizes, bounds):
    """Sizes as bytes: as many 255 as go into each, then the rest; ``bounds``, places in ``sizes``, become places in the bytes."""
    import numpy as np

    many = sizes // 255
    if not many.any():
        return sizes.astype(np.uint8), bounds
    ends = np.concatenate([[0], np.cumsum(many + 1)])
    out = np.full(ends[-1], 255, np.uint8)
    out[ends[1:] - 1] = sizes % 255
    return out, ends[bounds]


def _unpacked_sizes(packed):
    """The sizes that ``_packed_sizes`` put into these bytes."""
    import numpy as np

    ends = np.flatnonzero(packed < 255)
    if len(ends) == len(packed):
        return packed.astype(np.int64)
    return np.add.reduceat(packed, np.append(0, ends[:-1] + 1), dtype=np.int64)


def _units(ids_column, sizes_column):
    """Ids of the texts of two columns of ``encode_rows``, end to end, where each text's begin, where each
    word's and end's begin; which of these are ends; the words as spelt (an Arrow array)."""
    import numpy as np
    import pyarrow as pa

    ids, starts = _decoded(ids_column)
    units = np.concatenate([[0], np.cumsum(_unpacked_sizes(_flat(sizes_column)[0]))])
    last = np.zeros(len(ids) + 1, bool)
    last[starts[1:] - 1] = True
    ends = last[units[:-1]]
    return ids, starts, units[:-1], ends, _binary(ids, 2 * units).filter(pa.array(~ends))


def count_spelt(encoded: DataFrame) -> DataFrame:
    """(word, n) over the rows of ``encode_rows`` to learn from, words as spelt."""
    return encoded.select(F.inline("counted")).groupBy("word").agg(F.sum("n").alias("n"))


def _decoded(column):
    """Ids of the texts of a column of ``encode_rows``, end to end, and where each text's begin."""
    import numpy as np

    data, starts = _flat(column)
    return np.frombuffer(data.tobytes(), np.uint16), starts // 2


def refine(model: CausalModel, encoded: DataFrame) -> int:
    """Train over all texts of ``encoded``; every id is predicted once.  Returns how many were.

    In each round every partition takes steps on its texts of that round, from the weights of the round
    before; the new weights are the partitions' mean by ids.  The number of steps follows the corpus;
    which texts share a step follows from how they lie in partitions.
    """
    import numpy as np

    spark, shapes, trained = encoded.sparkSession, [w.shape for w in model.weights], 0
    ends = np.cumsum([w.size for w in model.weights])

    def merged(batches):
        """Mean weights and ids of all rows."""
        import pyarrow as pa

        total, n = 0.0, 0
        for batch in batches:
            for flat, k in zip(batch.column(0), batch.column(1).to_pylist()):
                total, n = total + k * np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.row_of, model.column_of, model.weights))
        rate = ROUND_RATE * (1 - turn / ROUNDS)

        def train(batches):
            import pyarrow as pa

            keep_freed()
            row_of, column_of, weights = shared.value
            own = CausalModel(None, column_of, row_of, None, None, None, None, None, None, list(weights))
            adam, rng, n = _Adam(own), np.random.default_rng((turn, TaskContext.get().partitionId())), 0
            for batch in batches:
                for part in _groups(batch):
                    ids, starts = _decoded(part.column(0))
                    train_on(own, adam, ids, starts, rng, rate)
                    n += len(ids)
            if n:
                flat = np.concatenate([w.ravel() for w in own.weights]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

        schema = "weights binary, n bigint"
        mine = encoded.where(F.col("round") == turn).select("ids")
        # One row per partition; about the square root of their number comes to the driver.
        few = int(np.ceil(np.sqrt(max(1, mine.rdd.getNumPartitions()))))
        found = mine.mapInArrow(train, schema).repartition(few).mapInArrow(merged, schema).collect()
        n = sum(r.n for r in found)
        if n:
            mean = sum(r.n / n * np.frombuffer(r.weights, np.float32).astype(np.float64) for r in found).astype(np.float32)
            model.weights[:] = [w.reshape(s) for w, s in zip(np.split(mean, ends[:-1]), shapes)]
        trained += n
        shared.unpersist()
    return trained


def learn_model(training: DataFrame, words: DataFrame, n_texts: int, tokenizer: str, spaced, end: int) -> tuple[CausalModel, int]:
    """The model of all training texts (doc_id, text), whose words are counted in ``words``, and the ids that it was trained on."""
    encoded = encode_rows(training.select("doc_id", "text", F.lit(True).alias("learn")), tokenizer, end)
    spelt = materialise(spell(words, tokenizer), "spelt")
    found = fit_model(encoded, spelt, n_texts, spaced, end)
    release(encoded, spelt)
    return found


def fit_model(encoded: DataFrame, spelt: DataFrame, n_texts: int, spaced, end: int) -> tuple[CausalModel, int]:
    """The model of encoded texts, whose words are counted in ``spelt``, and the ids that it was trained on."""
    import numpy as np

    size = len(spaced)
    none = np.full(size, -1)
    subwords, _ = count_subwords(spelt, none, none)
    group_of, follower_of = ranked_groups(subwords)
    group_of[end] = follower_of[end] = -1
    _, behind = count_subwords(spelt, group_of, follower_of)
    subwords[end] += n_texts
    company = count_company(encoded, top_subwords(subwords), size)
    model = prepare(subwords, behind, group_of, follower_of, spaced, company)
    return model, refine(model, encoded)


def _least(counts: DataFrame) -> int:
    """The least n for which at most FREQUENT words of ``counts`` occur so often."""
    total, least = 0, 1 << 62
    # One row per n: fewer than the square root of twice the tokens.
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        total += r.words
        if total > FREQUENT:
            break
        least = r.n
    return least


def score(docs: DataFrame, learn, tokenizer: str, end: int = 50256) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``learn`` is the condition on the rows whose texts may be learnt from.  A null text counts as
    empty and is its end alone.  Without any training text every word is unknown; rows that repeat
    are scored alike; an empty table gives an empty result; extra columns are ignored.
    """
    import numpy as np
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer)
    size = vocabulary.get_vocab_size()
    spaced = np.array([(vocabulary.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", learn.alias("learn"))
    encoded = encode_rows(rows, tokenizer, end)
    training = encoded.where("learn")
    counts = materialise(count_spelt(encoded), "words")
    n_texts = training.count()
    n_words, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    n_all, v = n_words + n_texts, distinct + (n_texts > 0)
    unknown = (once + 0.5) / (n_all + 1)
    by_share, by_net = WORD_PART * (1 - unknown), (1 - WORD_PART) * (1 - unknown)
    spaced[end] = True  # an end begins anew, as a word does
    model, _ = fit_model(training, counts, n_texts, spaced, end)
    # Frequent words: at most FREQUENT, of at most FREQUENT_BYTES bytes; whoever occurs as often as one of them is one.
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    top = short.where(F.col("n") >= _least(short)).toArrow()
    frequent = docs.sparkSession.sparkContext.broadcast((top.column(0).combine_chunks(), np.log10(top.column(1).to_numpy().astype(np.float64) + 1), model))
    end_log, unit_log = float(np.log10(n_texts + 1)), float(np.log10(n_all + v + 1))

    def judge(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        keep_freed()
        index, logs, fitted = frequent.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices([batch], 2, _JUDGED, _GROUP_BYTES):
                n = part.num_rows
                ids, starts, units, last, words = _units(part.column(2), part.column(3))
                firsts, ends = units[~last], starts[1:] - 1
                sizes = np.diff(np.flatnonzero(last), prepend=-1) - 1
                chance = np.zeros(len(ids))
                each, begins = fitted.log_chances(ids, starts)
                # Given that a unit begins here; a word ends where the next unit begins, which is in the same text.
                chance[units] = np.add.reduceat(each, units) - begins[units]
                chance[firsts] += begins[units[np.flatnonzero(~last) + 1]]
                place = pc.fill_null(pc.index_in(words, value_set=index), -1).to_numpy()
                where, net, seen = np.repeat(np.arange(n), sizes), chance[firsts], place >= 0
                known = np.bincount(where[seen], minlength=n)
                base = np.bincount(where[seen], logs[place[seen]], n)
                mixed = np.log(by_share * 10 ** (logs[place[seen]] - unit_log) + by_net * np.exp(net[seen]))
                last = np.log(by_share * 10 ** (end_log - unit_log) + by_net * np.exp(chance[ends]))
                found = (np.bincount(where[seen], mixed, n) + last) / _LOG10
                # The other words go on with the network's log10 probability of each.
                other = np.flatnonzero(~seen)
                bounds = np.searchsorted(where[other], np.arange(n + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([words.take(pa.array(other)), pa.array(net[other] / _LOG10)], names=["word", "net"])
                columns = [
                    pa.array(np.arange(uid, uid + n)),
                    part.column(0),
                    part.column(1),
                    pa.array(sizes + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(found),
                    pa.ListArray.from_arrays(pa.array(bounds), rest),
                ]
                uid += n
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "learn", "n_tokens", "known", "base", "score", "rest"])

    judged = materialise(
        encoded.select("doc_id", "learn", "ids", "sizes").mapInArrow(
            judge, "uid bigint, doc_id bigint, learn boolean, n_tokens bigint, known bigint, base double, score double, rest array<struct<word:binary,net:double>>"
        ),
        "judged",
    )
    release(encoded)
    rest = judged.select("uid", F.inline("rest")).join(counts, "word", "left")
    plus = F.coalesce("n", F.lit(0)) + F.lit(1.0)
    unit = F.lit(1.0 / float(n_all + v + 1))
    known = F.log10(F.lit(by_share) * plus * unit + F.lit(by_net) * F.pow(F.lit(10.0), F.col("net")))
    mixed = F.when(F.col("n").isNull(), F.log10(F.lit(by_share) * unit + F.lit(unknown))).otherwise(known)
    rest = rest.groupBy("uid").agg(F.count("n").alias("rest_known"), F.sum(F.log10(plus)).alias("rest_base"), F.sum(mixed).alias("rest_score"))
    out = judged.drop("rest").join(rest, "uid", "left")
    ends = 1 if n_texts else 0
    return out.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + F.lit(ends)).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(unit_log)).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; null texts are an end alone."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, ~held_out(F.col("doc_id"), 7, 2), public_tokenizers.path("byte_bpe_50k.json"))
