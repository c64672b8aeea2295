"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once."""

from __future__ import annotations

import re

#: Distinct pieces that one Python worker remembers; then it starts afresh.  About 250 bytes each.
REMEMBERED = 800_000
_SPACE = r"\s\x1c-\x1f\x85\xa0"
#: A blank or line break with white space beside it: there the pieces aren't independent for a byte-level tokenizer.
_CROWDED = re.compile(f"[{_SPACE}][ \n]|[ \n][{_SPACE}]")
#: Words that are cut off their punctuation and encoded many at a time: letters of Latin-1 behind at most
#: one blank, then ASCII punctuation but the apostrophe, which both tokenizers may join to letters.
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words in one call of the tokenizer.
_JOINED = 4096


#: Rows, and bytes of text, that are encoded at once (a longer text alone).
ROWS, BYTES = 2048, 1 << 24


def slices(batches, column: int, rows: int = ROWS, most: int = BYTES):
    """Parts of Arrow batches of at most so many rows and bytes of text in ``column``; a text of more bytes is a part alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            begin = ends[at] - sizes[at]
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, begin + most, "right"))))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker stays alive behind its task, and others need the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def keep_freed(most: int = 1 << 26) -> None:
    """Let this worker keep up to so much freed memory for its next arrays: else the system clears the same pages for each."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 23)  # larger blocks are mapped alone
        libc.mallopt(-1, most)  # what may stay at the end of the heap
    except (OSError, AttributeError):
        pass  # another C library


class PieceEncoder:
    """Encodes texts piece by piece and joins the ids.

    Both kinds of tokenizer split a text before they merge: a byte-level one in front of a blank and
    around a line break (when no white space is beside them), a word-level one at all white space.  So
    the ids of a text are those of its pieces in order; texts where a piece could depend on the next
    are encoded whole.  Both split letters from punctuation too, so a new piece of letters and
    punctuation has the ids of the one, then of the other; and many new words are encoded in one call,
    as the ids tell where a word begins or ends.  The string of an added token holds no white space, so
    it lies in one piece and gets its own id, as in the library.  The tests compare both ways.
    """

    _known: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks_kept = self.tokenizer.normalizer is None
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Ids that begin a word with a blank, or end a word.
        self._marks = np.array([t.startswith("\u0120") if self.blanks_kept else t.endswith("</w>") for t in tokens])
        self.remembered = remembered
        self._forget()

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> "PieceEncoder":
        """One for each file and worker process, so that later tasks find earlier pieces."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        cls._known[path].remembered = remembered
        return cls._known[path]

    def _forget(self) -> None:
        import numpy as np

        self._place: dict[str, int] = {}
        self._pool = np.zeros(1 << 16, np.uint16)
        self._start = np.zeros(1 << 14, np.int64)
        self._odd = np.zeros(1 << 14, bool)
        self._uses = np.zeros(1 << 14, np.uint16)
        self._used = 0

    def _forget_rare(self) -> None:
        """Keep the pieces that several calls asked for, at most a quarter of what may be remembered."""
        import numpy as np

        n = len(self._place)
        uses = self._uses[:n]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.remembered // 4:
            kept = np.sort(kept[np.argsort(-uses[kept].astype(np.int64), kind="stable")[: self.remembered // 4]])
        flat, before = self.ids_at(kept)
        pieces, odd, uses = np.array(list(self._place), object)[kept].tolist(), self._odd[kept], uses[kept] // 2 + 1
        self._forget()
        self._add(pieces, flat, np.diff(before))
        self._odd[: len(kept)], self._uses[: len(kept)] = odd, uses

    def _add(self, pieces: list[str], flat, sizes) -> None:
        """Remember pieces with these ids (end to end) and counts of ids."""
        import numpy as np

        first, n = len(self._place), len(pieces)
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while first + n + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
            self._odd = np.concatenate([self._odd, np.zeros_like(self._odd)])
            self._uses = np.concatenate([self._uses, np.zeros_like(self._uses)])
        self._pool[self._used : self._used + len(flat)] = flat
        self._start[first + 1 : first + n + 1] = self._used + np.cumsum(sizes)
        self._used += len(flat)
        self._place.update(zip(pieces, range(first, first + n)))

    def _learn_each(self, pieces: list[str]) -> None:
        """Encode pieces of any kind, one by one."""
        import numpy as np

        for at in range(0, len(pieces), 50_000):
            part = pieces[at : at + 50_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            first = len(self._place)
            self._add(part, np.fromiter((i for x in ids for i in x), np.uint16, int(sizes.sum())), sizes)
            bare = (p[1:] if p[:1] == " " else p for p in part)
            self._odd[first : first + len(part)] = [b != "\n" and (not b or b[0].isspace() or b[-1].isspace()) for b in bare]

    def _learn_words(self, words: list[str]) -> None:
        """Encode words of letters alone, many in one call; a byte-level tokenizer's have their blank."""
        import numpy as np

        between = "" if self.blanks_kept else " "
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            joined = [between.join(part[i : i + _JOINED]) for i in range(0, len(part), _JOINED)]
            flat = np.concatenate([np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            marks = np.flatnonzero(self._marks[flat])
            if len(marks) != len(part):
                raise ValueError("the tokenizer doesn't split words as expected")
            bounds = np.append(marks, len(flat)) if self.blanks_kept else np.append(0, marks + 1)
            self._add(part, flat, np.diff(bounds))

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        lead = " " if self.blanks_kept else ""
        stems = [p.rstrip(_PUNCTUATION) for p in pieces]
        # A word is its blank (for a byte-level tokenizer) and letters; ASCII, nearly always, is quick to tell.
        skip, letters = len(lead), _LETTERS.fullmatch
        word = [s.startswith(lead) and (s[skip:].isalpha() if s.isascii() else letters(s, skip) is not None) for s in stems]
        single = [p for p, w in zip(pieces, word) if not w]
        if single:
            pieces, stems = [p for p, w in zip(pieces, word) if w], [s for s, w in zip(stems, word) if w]
        if not self.blanks_kept:
            stems = list(map(str.lower, stems))  # what this kind of tokenizer does first
        place = self._place
        self._learn_words([s for s in dict.fromkeys(stems) if s not in place])
        cut = [(p, s) for p, s in zip(pieces, stems) if p not in place]
        tails = [p[len(s) :] for p, s in cut]
        self._learn_each(list(dict.fromkeys(single + [t for t in set(tails) if t and t not in place])))
        if cut:
            where = np.empty((len(cut), 2), np.int64)
            where[:, 0] = [place[s] for _, s in cut]
            where[:, 1] = [place[t] if t else -1 for t in tails]
            flat, before = self.ids_at(where[where >= 0])
            ends = before[np.cumsum((where >= 0).sum(1))]
            self._add([p for p, _ in cut], flat, np.diff(ends, prepend=0))

    def _cut(self, texts):
        """The pieces of all texts, as an Arrow list array."""
        import pyarrow.compute as pc

        if self.blanks_kept:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
            return pc.split_pattern(texts, "\x00")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def _cut_checked(self, texts):
        """The same where some text can't be cut: such a text is one piece."""
        import numpy as np
        import pyarrow as pa

        whole = np.array(["\x00" in t or bool(self.blanks_kept and _CROWDED.search(t)) for t in texts.to_pylist()])
        order = np.argsort(np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)]))
        kept = texts.filter(pa.array(whole))
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32)), kept)
        return pa.concat_arrays([self._cut(texts.filter(pa.array(~whole))), single]).take(pa.array(order))

    def places(self, words: list[str]):
        """Place of every piece (distinct ones) in what is remembered; pieces seen for the first time are encoded."""
        import numpy as np

        if len(self._place) + len(words) > self.remembered and len(self._place) > self.remembered // 4:
            self._forget_rare()
        place = self._place
        self._learn([w for w in words if w not in place])
        known = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self._uses[known] = np.minimum(self._uses[known], 60_000) + 1
        return known

    def ids_at(self, where):
        """Ids of the pieces at these places, end to end, and where each piece's begin (with the total as one more)."""
        import numpy as np

        starts, sizes = self._start[where], self._start[where + 1] - self._start[where]
        before = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat((starts - before[:-1]).astype(np.int32), sizes)
        where += np.arange(int(before[-1]), dtype=np.int32)
        return self._pool[where], before

    def _placed(self, cut):
        coded = cut.values.dictionary_encode()
        known = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return known, known[coded.indices.to_numpy()]

    def encode(self, texts, end: int):
        """``texts``: an Arrow string array, null counts as empty.

        Returns the ids (uint16) of all texts, each followed by ``end``, and the start of each text in
        them, with the total as one more.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        cut = self._cut_checked(texts) if pc.any(pc.match_substring(texts, "\x00")).as_py() else self._cut(texts)
        known, where = self._placed(cut)
        if self.blanks_kept and self._odd[known].any():
            cut = self._cut_checked(texts)
            known, where = self._placed(cut)
        flat, before = self.ids_at(where)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        stops = before[bounds[1:] - bounds[0]]
        out = np.insert(flat, stops, np.uint16(end))
        return out, np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


class WordMemory:
    """Subword ids of words, each with a blank before it; what several calls asked for is remembered.

    As in ``PieceEncoder``, a word of letters and punctuation has the ids of the one, then of the other,
    and many words of letters are encoded in one call; but words stay Arrow arrays, without an object each.
    """

    def __init__(self, encoder: PieceEncoder):
        import numpy as np
        import pyarrow as pa

        self.encoder = encoder
        self.words, self.flat, self.bounds, self.uses = pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, encoder: PieceEncoder) -> "WordMemory":
        """One for each encoder."""
        if not hasattr(encoder, "word_memory"):
            encoder.word_memory = cls(encoder)
        return encoder.word_memory

    def ids_of(self, words):
        """Ids of the words of an Arrow array (distinct ones), end to end, and where each word's begin (with the total as one more)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        known, new = len(self.words), np.flatnonzero(place < 0)
        self.uses[place[place >= 0]] += 1
        if len(new):
            fresh = words.take(pa.array(new))
            flat, sizes = self._spell(fresh)
            place[new] = known + np.arange(len(new))
            self.words, self.flat = pa.concat_arrays([self.words, fresh]), np.concatenate([self.flat, flat])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.uses = np.concatenate([self.uses, np.ones(len(new), np.int64)])
        out = gathered(self.flat, self.bounds, place)
        if len(self.words) > self.encoder.remembered:
            self._forget_rare()
        return out

    def _forget_rare(self) -> None:
        """Keep the words that several calls asked for, at most half of what may be remembered."""
        import numpy as np
        import pyarrow as pa

        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.encoder.remembered // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.encoder.remembered // 2]])
        self.flat, self.bounds = gathered(self.flat, self.bounds, kept)
        self.words, self.uses = self.words.take(pa.array(kept)), self.uses[kept] // 2 + 1

    def _spell(self, words):
        """Ids of new words, end to end, and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        stems = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        letters = pc.match_substring_regex(stems, f"^{_LETTERS.pattern}$").to_numpy(zero_copy_only=False)
        if not self.encoder.blanks_kept:
            letters[:] = False
        # The parts of each word: its stem and its tail, or itself.
        at = np.flatnonzero(letters)
        stems = stems.take(pa.array(at)).dictionary_encode()
        tails = _behind(words.take(pa.array(at)), stems).dictionary_encode()
        old = pc.fill_null(pc.index_in(stems.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(old < 0)
        flat, sizes = self._spell_letters(stems.dictionary.take(pa.array(unknown)))
        single = [" " + w for w in words.filter(pa.array(~letters)).to_pylist()] + tails.dictionary.to_pylist()
        more = [e.ids for k in range(0, len(single), 50_000) for e in self.encoder.tokenizer.encode_batch_fast(single[k : k + 50_000], add_special_tokens=False)]
        more_sizes = np.fromiter(map(len, more), np.int64, len(more))
        pool = np.concatenate([self.flat, flat, np.fromiter((i for x in more for i in x), np.uint16, int(more_sizes.sum()))])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([sizes, more_sizes]))])
        known, odd = len(self.words) + len(unknown), len(words) - len(at)
        old[unknown] = len(self.words) + np.arange(len(unknown))
        parts = np.full((len(words), 2), -1)
        parts[at, 0] = old[stems.indices.to_numpy()]
        parts[at, 1] = known + odd + tails.indices.to_numpy()
        parts[~letters, 0] = known + np.arange(odd)
        used = parts >= 0
        out, ends = gathered(pool, bounds, parts[used])
        return out, np.diff(ends[np.cumsum(used.sum(1))], prepend=0)

    def _spell_letters(self, words):
        """Ids of words of letters alone, end to end, and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        cuts = np.append(np.arange(0, len(words), _JOINED), len(words)).astype(np.int32)
        joined = [" " + t for t in pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()]
        flat = np.concatenate([np.array(e.ids, np.uint16) for e in self.encoder.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(self.encoder._marks[flat])
        if len(marks) != len(words):
            raise ValueError("the tokenizer doesn't split words as expected")
        return flat, np.diff(np.append(marks, len(flat)))


def _behind(words, stems):
    """What each of ``words`` (an Arrow array) has behind its stem."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    rest = sizes - pc.binary_length(stems.dictionary).to_numpy()[stems.indices.to_numpy()]
    first = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)[:-1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(rest)])
    tail = data[np.arange(bounds[-1]) + np.repeat(first + sizes - rest - bounds[:-1], rest)]
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(tail.tobytes())])


def gathered(flat, bounds, where):
    """Of ids end to end, with ``bounds``, those of the pieces ``where``, and where each of these begins (with the total as one more)."""
    import numpy as np

    starts, sizes = bounds[where], bounds[where + 1] - bounds[where]
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat((starts - before[:-1]).astype(np.int32), sizes)
    at += np.arange(int(before[-1]), dtype=np.int32)
    return flat[at], before
